"""Token counts with a digest cache."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlake.llm import chunked
from martlake.llm.common import documents_of, map_batches, stage_path, staged, texts

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of the library's version: a change of either makes new cache entries."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


@lru_cache(maxsize=4)
def _counter(path: str) -> chunked.TextEncoder:
    return chunked.TextEncoder(path, "byte_level")


def _encode(path: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = _counter(path).counts(texts(batch))
        return pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 512) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    The content digest is the SHA-256 of the text (null: of the empty text). Digests are joined to the counts stored in
    ``cache_path`` under the tokenizer's version, only distinct texts without a stored count are encoded, and their
    counts are appended. Without ``cache_path`` the cache lives in the shared folder for this call only. Special
    strings inside a text are handled as the library does by default; nothing is added, cut or padded.

    Null ids are kept. Repeated rows give repeated rows. An empty table gives an empty result. A writer that fails
    midway leaves no entry, and two writers at once at most leave the same entry twice, which readers collapse.
    The tokenizer file must be readable at the same path on every executor.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    cache_path = cache_path or stage_path(spark, "token-counts")
    text = F.coalesce("text", F.lit(""))
    keyed = documents_of(docs).select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def stored() -> DataFrame:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
        return cache.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    misses = keyed.select("digest", "text").join(stored(), "digest", "left_anti").dropDuplicates(["digest"])
    new = map_batches(misses, _encode(tokenizer_path), "digest binary, n_tokens long")
    new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)

    sized = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    # written first, so that the join stands on plain exchanges and a digest that many rows share can be split
    return sized.join(staged(stored(), "counts"), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

