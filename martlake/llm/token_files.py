"""Token ids in files of bit planes.

A file set is a folder of Parquet files that Spark commits, one row for each block. A block holds ``BLOCK_IDS`` ids of
consecutive documents (the last of a part fewer): its ids are transposed into planes of one bit (or one byte) of every
id, each plane is a zstandard frame. The other columns are the chunk index: a reader that prunes ``planes`` reads only
that. Columns: part, block, first (ids of the part before the block), n_ids, width (bits of an id), ord (the part's
documents before the block's first one), doc_ids and doc_lens (documents with ids in the block, and how many), begins
and ends (whether the first document begins and the last one ends here), planes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from martlake.llm import chunked
from martlake.llm.common import bounded_batches, documents_of, map_batches, shuffle_partitions, texts, tidy

BLOCK_IDS = 1 << 16
BLOCKS = (
    "part int, block int, first long, n_ids int, width int, ord long, doc_ids array<long>, doc_lens array<int>, "
    "begins boolean, ends boolean, planes array<binary>"
)
_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("width", pa.int32()),
        ("ord", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int32())),
        ("begins", pa.bool_()), ("ends", pa.bool_()), ("planes", pa.list_(pa.binary())),
    ]
)


def to_planes(ids: np.ndarray, bits: bool = True) -> list[bytes]:
    """Compressed planes of an array of unsigned 16- or 32-bit ids, lowest first."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    raw = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), ids.itemsize)
    if not bits:
        return [pack(raw[:, k].tobytes()) for k in range(ids.itemsize)]
    return [pack(np.packbits(raw[:, k] >> b & 1, bitorder="little").tobytes()) for k in range(ids.itemsize) for b in range(8)]


def from_planes(planes: list[bytes], n: int, width: int) -> np.ndarray:
    """The ids of a block of ``n`` ids of ``width`` bits."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    raw = np.zeros((n, width // 8), np.uint8)
    if len(planes) * 8 == width:
        for k, x in enumerate(planes):
            raw[:, k] = np.frombuffer(unpack(x), np.uint8)
    else:
        for k, x in enumerate(planes):
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(unpack(x), np.uint8), count=n, bitorder="little") << (k % 8)
    return raw.view(f"<u{width // 8}").ravel()


@lru_cache(maxsize=4)
def _encoder(path: str) -> chunked.TextEncoder:
    return chunked.TextEncoder(path, "word_end")


def _writer(path: str, width: int, end_id: int, block_ids: int, bits: bool):
    size = width // 8
    end = end_id.to_bytes(size, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first, done = TaskContext.get().partitionId(), 0, 0, 0
        buffer, held = bytearray(), []  # held: [doc_id, ids not yet written, whether some were written]

        def cut(n: int) -> pa.RecordBatch:
            nonlocal block, first, done
            ids, left, own = np.frombuffer(bytes(buffer[: n * size]), f"<u{size}"), n, []
            del buffer[: n * size]
            begins, ord_ = not held[0][2], done
            while left:
                doc = held[0]
                take = min(left, doc[1])
                own.append((doc[0], take))
                left, doc[1], doc[2] = left - take, doc[1] - take, True
                if not doc[1]:
                    held.pop(0)
                    done += 1
            ends = not held or not held[0][2]
            row = {
                "part": part, "block": block, "first": first, "n_ids": n, "width": width, "ord": ord_,
                "doc_ids": [x for x, _ in own], "doc_lens": [x for _, x in own], "begins": begins, "ends": ends,
                "planes": to_planes(ids, bits),
            }
            block, first = block + 1, first + n
            return pa.RecordBatch.from_pylist([row], _ARROW)

        encoder = _encoder(path)
        for batch in batches:
            ids, bounds = encoder.encode(texts(batch))
            ids, bounds = ids.astype(f"<u{size}").tobytes(), (bounds * size).tolist()
            for doc_id, b, e in zip(batch.column("doc_id").to_pylist(), bounds, bounds[1:], strict=False):
                buffer += ids[b:e]
                buffer += end
                held.append([doc_id, (e - b) // size + 1, False])
                while len(buffer) >= block_ids * size:
                    yield cut(block_ids)
        if buffer:
            yield cut(len(buffer) // size)

    return run


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, block_ids: int = BLOCK_IDS, bits: bool = True) -> None:
    """Encode every text (null: empty), end each document with ``end_id`` and write the file set at ``path``.

    Documents go in ascending order of id (null first, equal ids by text) through one range exchange; a part is one
    range. Ids take 16 bits if the vocabulary allows, else 32. An empty table writes an empty file set.
    """
    bounded_batches(docs.sparkSession)
    width = 16 if max(chunked.load(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 32
    parts = documents_of(docs).repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    parts.mapInArrow(tidy(_writer(tokenizer_path, width, end_id, block_ids, bits)), BLOCKS).write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index, with ``base``: the ids of all parts before."""
    index = spark.read.schema(BLOCKS).parquet(path).drop("planes")
    # One row for each part, so the running sum is over a table of the size of the partition count.
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return index.join(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "part")


_PIECES = "part int, ord long, block int, doc_id long, at long, n long, whole boolean, crc long, ids binary"


def _reader(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for r in batch.to_pylist():
        ids = from_planes(r["planes"], r["n_ids"], r["width"]).astype("<u4")
        at, last = 0, len(r["doc_ids"]) - 1
        for k, (doc_id, n) in enumerate(zip(r["doc_ids"], r["doc_lens"], strict=True)):
            whole = (k > 0 or r["begins"]) and (k < last or r["ends"])
            own = ids[at : at + n].tobytes()
            rows.append((r["part"], r["ord"] + k, r["block"], doc_id, r["first"] + at, n, whole, zlib.crc32(own) if whole else None, None if whole else own))
            at += n
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32.

    Blocks are decoded where they're read. What is shuffled is a short row for each document, with ids only for those
    that cross a block's edge (at most two for each block), whose pieces are joined.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    pieces = map_batches(spark.read.schema(BLOCKS).parquet(path), _reader, _PIECES)
    # An id's row count is that of the blocks it crosses; only documents across an edge carry ids here.
    ids = F.aggregate(F.array_sort(F.collect_list(F.when(~F.col("whole"), F.struct("block", "ids")))), F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    documents = pieces.groupBy("part", "ord").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n"), F.max("crc").alias("whole"), F.crc32(ids).alias("joined")
    )
    base = read_index(spark, path).select("part", "base").distinct()
    return (
        documents.join(F.broadcast(base), "part")  # one row for each part
        .select("doc_id", (F.col("base") + F.col("at")).cast("long").alias("start"), F.col("n").alias("n_tokens"), F.coalesce("whole", "joined").alias("ids_crc32"))
    )
