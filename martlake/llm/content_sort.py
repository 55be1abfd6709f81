"""Exact duplicates by sorting content: DataFrame functions only, no Python workers.

Rows are range-partitioned by their normalised text with sampled splitters, each partition is sorted externally, and
equal texts become neighbours that are compared in full. The range key of a text is its beginning and a 64-bit hash, so
that what's sampled for the splitters is short however long the texts are; a run of neighbours is one of equal texts,
since the whole text is the last sort key. The hash only brings equal texts closer; it never decides.

A text with many copies would fill one partition. Copies are counted first (by hash, summed before the shuffle); a hash
with more than ``HOT_SHARE`` of a partition's rows gets that many pieces, its rows are dealt over them, and each piece
makes a run of its own. There are at most ``2 * parts / HOT_SHARE`` such pieces, so the table of hot hashes and that of
the runs' leaders are bounded by the number of partitions, not by the rows. The leaders of the pieces are compared by
their whole texts again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlake.llm.common import documents_of, fresh, shuffle_partitions, staged

#: The characters that normalising deletes, space and tab to carriage return.
DELETED = [" ", "\t", "\n", "\x0b", "\f", "\r"]
#: Characters of the text's beginning in the range key.
HEAD = 64
#: A text is hot when its copies are more than this share of a partition's rows, and more than HOT_ROWS.
HOT_SHARE, HOT_ROWS = 0.25, 64


def normalised(text: Column) -> Column:
    """The text (null: empty) without the deleted characters."""
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), DELETED, F.coalesce(text.cast("string"), F.lit("")))


def hot_hashes(keyed: DataFrame, parts: int) -> DataFrame:
    """hash, pieces: the hashes of texts with many copies and the number of pieces that their rows are dealt into.

    At most ``parts / HOT_SHARE`` rows, since each stands for more than its share of all of them.
    """
    counts = keyed.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"))
    total = keyed.agg(F.greatest(F.lit(HOT_ROWS), (F.count(F.lit(1)) * HOT_SHARE / parts).cast("long")).alias("most"))
    return counts.crossJoin(F.broadcast(total)).where("copies > most").select("hash", F.ceil(F.col("copies") / F.col("most")).alias("pieces"))


def _grouped(rows: DataFrame, *carried: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the carried columns of each row."""
    parts = shuffle_partitions(rows.sparkSession)
    text = normalised(F.col("text"))
    keyed = rows.select("doc_id", *carried, text.alias("norm"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), F.xxhash64(text).alias("hash"))
    hot = staged(hot_hashes(keyed.select("hash"), parts), "hot-texts")
    # a row's number within its task deals out the rows of a hot text evenly, repeated rows as well
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("pieces"))).otherwise(F.lit(0))
    dealt = keyed.join(F.broadcast(hot), "hash", "left").select("*", F.substring("norm", 1, HEAD).alias("head"), piece.alias("piece"))
    ranged = dealt.repartitionByRange(parts, "head", "hash", "piece")

    run = Window.partitionBy("head", "hash", "piece", "norm").orderBy(F.desc("n_chars"), F.asc_nulls_last("doc_id"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = ranged.select(
        "doc_id", *carried, "piece", F.col("pieces").isNotNull().alias("hot"), F.row_number().over(run).alias("n"),
        F.first(F.struct("n_chars", "doc_id")).over(run).alias("best"), F.count(F.lit(1)).over(whole).alias("size"),
        F.sha2("norm", 256).alias("text_sha256"), "norm",
    )
    leader = F.col("hot") & (F.col("n") == 1)
    marked = staged(runs.withColumn("norm", F.when(leader, F.col("norm"))), "runs")  # only leaders of hot runs keep their text

    order = F.struct(-F.col("best.n_chars"), F.col("best.doc_id").isNull(), "best.doc_id", "piece")
    chosen = [F.min_by(F.struct("best", "piece"), order).alias("first"), F.sum("size").alias("all"), F.first("text_sha256").alias("sha")]
    merged = marked.where("norm IS NOT NULL").groupBy("norm").agg(*chosen).drop("norm")
    joined = marked.drop("norm").join(F.broadcast(merged), F.col("hot") & (F.col("text_sha256") == F.col("sha")), "left")
    best, piece = F.coalesce("first.best", "best"), F.coalesce("first.piece", "piece")
    kept = (F.col("n") == 1) & (F.col("piece") == piece)
    return joined.select("doc_id", best["doc_id"].alias("keep_id"), F.coalesce("all", "size").alias("group_size"), kept.alias("kept"), "text_sha256", *carried)


def find_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``.

    Texts are equal when they're identical after deleting whitespace. Of equal ones the row with the most code points in
    the original text stays, then that of smallest id (null last); ``keep_id`` is its id, ``group_size`` the rows of the
    group, ``text_sha256`` the digest of the normalised text. Of repeated rows exactly one stays. Null texts are empty,
    and equal to texts of whitespace alone. An empty table gives an empty result; other columns don't matter.
    """
    return _grouped(documents_of(docs))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rules as in :func:`find_copies`."""
    (row,) = fresh(docs, "row")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    kept = _grouped(documents_of(numbered, row), row).where("kept").select(row)
    return numbered.join(kept, row, "left_semi").drop(row)
