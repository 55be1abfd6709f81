"""Resampling of documents towards a target distribution by hashed n-gram importance weights.

Features are runs of one to ``NGRAM`` consecutive words, hashed by the CRC-32 of their bytes into ``BUCKETS`` buckets.
One scan of a text keeps, for the last starts, the running zlib state of the run that began there: the next word extends
each state by a space and the word, so a run's bytes are never put together. A piece of ``PIECE`` words is extended at a
time, and the states are carried on to the next piece, so a text of any length takes bounded memory besides itself.

The scan writes each document's buckets, two bytes a feature. Bucket counts, weights and scores are computed from these;
texts aren't read again. The draw is a race of Gumbel keys: highest scores first, numbered by ranges of the order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlake.llm.common import bounded_batches, documents_of, map_batches, numbered, staged, texts, tidy

NGRAM, BUCKETS = 3, 10_000
#: Words that are extended at a time.
PIECE = 1 << 16
#: A document needs so many words to be drawn; so many of 100 of those are drawn; seed of the noise.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42

#: A-Z become a-z; ASCII bytes that no word has become spaces; all other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SCANNED = "doc_id long, n_words long, n_features long, buckets binary"


def words_of(text: str) -> list[bytes]:
    """The words of a text, ASCII letters in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def emit_buckets(words: list[bytes], ngram: int = NGRAM, buckets: int = BUCKETS, piece: int = PIECE) -> Iterator[np.ndarray]:
    """The buckets of all features of a list of words, in arrays of those that end in one piece."""
    ring: list[int] = []  # running states of the last starts, the latest last, each as long as the words since
    for at in range(0, len(words), piece):
        part = words[at : at + piece]
        spaced = [b" " + w for w in part]
        states = list(map(zlib.crc32, part))  # runs of one word
        found, tails = [states], [states[-1]]
        for n in range(1, ngram):
            # the run of n + 1 words that ends in a word extends the run of n that ended in the word before
            before = ([ring[n - 1]] if len(ring) >= n else []) + states[:-1]
            states = list(map(zlib.crc32, spaced[len(spaced) - len(before) :], before))
            if not states:
                break
            found.append(states)
            tails.append(states[-1])
        ring = tails
        yield np.concatenate([np.fromiter(x, np.uint32, len(x)) for x in found]) % np.uint32(buckets)


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes, packed = [], []
    for text in texts(batch).to_pylist():
        words = words_of(text)
        sizes.append(len(words))
        packed.append(b"".join(x.astype("<u2").tobytes() for x in emit_buckets(words)))
    features = [len(x) // 2 for x in packed]
    columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(features, pa.int64()), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "buckets"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, buckets (16-bit little-endian, one for each feature) of every row."""
    return map_batches(documents_of(docs), _scan, _SCANNED)


def bucket_counts(scanned: DataFrame) -> np.ndarray:
    """Features in each bucket: every task adds up its own, so that a row for each bucket and task is shuffled."""
    bounded_batches(scanned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for packed in batch.column("buckets"):
                sums += np.bincount(np.frombuffer(packed.as_buffer(), "<u2"), minlength=BUCKETS)
        used = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used], pa.int64())], ["bucket", "n"])

    sums = scanned.select("buckets").mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in sums.collect():  # at most BUCKETS rows
        out[bucket] = n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target by that in the source, rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(scanned: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the sum of the gains of a document's features."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        weight = [int(gain[np.frombuffer(x.as_buffer(), "<u2")].sum()) for x in batch.column("buckets")]
        columns = [batch.column(c) for c in ("doc_id", "n_words", "n_features")] + [pa.array(weight, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return map_batches(scanned, run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, doc_id: Column) -> Column:
    """Thousandths of a Gumbel variate that is drawn from the seed and the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: every row of ``docs``, ``rank`` from 1 for those drawn and null else.

    ``target`` has a text column; what it's resampled towards is the distribution of its features. Of the N documents
    with ``LEAST_WORDS`` words, ``percent * N / 100`` (rounded down) are drawn: those of highest score, ties to the
    smaller id (null last; the noise of a null id is drawn from the empty text). Null texts have no words and weigh 0.
    Repeated rows are rows of their own and may both be drawn. An empty table gives an empty result, an empty target
    has equal shares. Other columns don't matter.
    """
    scanned = staged(scan(docs), "buckets")
    wanted = staged(scan(target.select(F.lit(0).alias("doc_id"), "text")), "target-buckets")
    weighed = weigh(scanned, gains(bucket_counts(wanted), bucket_counts(scanned)))
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise(seed, F.col("doc_id"))).alias("score"), (F.col("n_words") >= LEAST_WORDS).alias("fit"))
    drawn = scanned.where(F.col("n_words") >= LEAST_WORDS).count() * percent // 100
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = numbered(scored, "rank", *order)
    rank = F.when(F.col("fit") & (F.col("rank") <= drawn), F.col("rank"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
