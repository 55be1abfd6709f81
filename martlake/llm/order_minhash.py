"""Order MinHash fingerprints, in DataFrame functions only.

The k-mers of a text are runs of ``SHINGLE`` words. Each is numbered by its earlier occurrences in the text, so the
numbered k-mers are a set that knows about repeats. One hash deals them into ``BINS`` bins; each bin selects its two
least hashes, puts these k-mers back into text order and hashes the tuple. A bin agrees between two texts only if they
share the selected k-mers and have them in the same order, which is what makes the likeness follow the edit distance
and not only the sets. A fingerprint holds, for each bin that has k-mers, the bin's number (6 bits) and its tuple's
hash (18 bits); the likeness of two is the share of equal entries among the bins that either has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from martlake.llm.common import shuffle_partitions

#: Words of a k-mer, and bins.
SHINGLE, BINS = 3, 64
#: Ranges of ids for each shuffle partition when documents are put in order.
RANGES = 8


def with_entries(df: DataFrame, text: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the fingerprint's entries (array<int>, in order of bins) of a text column; none of a null or wordless
    text. A text of fewer words than a k-mer is one k-mer. Each step is a column of its own, so that none runs twice."""
    c = lambda x: f"__{name}_{x}"
    col = lambda x: F.col(c(x))
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\x09-\\x0D]+"), "")
    df = df.withColumn(c("w"), F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size(col("w"))
    last = F.greatest(n - shingle, F.lit(0))
    at = lambda i: F.xxhash64(*(F.get(col("w"), i + j) for j in range(shingle)))
    kmers = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(at(i).alias("k"), i.alias("p")))
    df = df.withColumn(c("s"), F.when(n > 0, F.sort_array(kmers)).otherwise(F.array().cast("array<struct<k:bigint,p:int>>")))
    size = F.size(col("s"))
    # most texts repeat no k-mer: then all numbers are zero, and the runs of equal ones needn't be found
    df = df.withColumn(c("d"), F.size(F.array_distinct(col("s")["k"])) < size)
    starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(col("s"), i)["k"] != F.get(col("s"), i - 1)["k"]))
    df = df.withColumn(c("r"), F.when(col("d"), F.array_append(starts, size)))
    runs = F.transform(F.sequence(F.lit(0), F.size(col("r")) - 2), lambda j: F.sequence(F.lit(0), F.get(col("r"), j + 1) - F.get(col("r"), j) - 1))
    df = df.withColumn(c("o"), F.when(col("d"), F.flatten(runs)).otherwise(F.array_repeat(F.lit(0), size)))

    def numbered(s: Column, o: Column) -> Column:
        g = F.xxhash64(s["k"], o)
        return F.struct(F.shiftrightunsigned(g, 58).cast("int").alias("b"), g.alias("g"), s["p"].alias("p"))

    df = df.withColumn(c("e"), F.sort_array(F.zip_with(col("s"), col("o"), numbered)))
    df = df.withColumn(c("t"), F.filter(col("e"), lambda x, i: (i < 2) | (F.get(col("e"), i - 2)["b"] != x["b"])))

    def signature(x: Column, i: Column) -> Column:
        after = F.get(col("t"), i + 1)
        pair = after["b"] == x["b"]
        ordered = F.when(~F.coalesce(pair, F.lit(False)), F.xxhash64(x["g"])).when(x["p"] < after["p"], F.xxhash64(x["g"], after["g"])).otherwise(F.xxhash64(after["g"], x["g"]))
        return F.when((i == 0) | (F.get(col("t"), i - 1)["b"] != x["b"]), F.shiftleft(x["b"], 18) + F.shiftrightunsigned(ordered, 46).cast("int"))

    df = df.withColumn(name, F.array_compact(F.transform(col("t"), signature)))
    return df.drop(*map(c, "wsdroet"))


def as_string(entries: Column) -> Column:
    """A fingerprint's text: six hexadecimal digits for each entry."""
    return F.array_join(F.transform(entries, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints' entries, from 0 to 1; two without entries are alike."""
    bins = lambda x: F.transform(x, lambda e: F.shiftright(e, 18))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def _ranges(docs: DataFrame, n: int) -> Column:
    """The number of the id range that a row belongs to: n ranges at most, of about as many rows each; null ids come first.

    The bounds are quantiles of the ids alone. They're held as two levels of about the square root of n, so that a
    row's range takes few steps.
    """
    accuracy = max(10_000, 20 * n)
    shares = [k / n for k in range(1, n)]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), accuracy).alias("q")).first() if shares else None
    bounds = sorted(set(found.q)) if found and found.q else []
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    fine = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    below = lambda bounds: F.size(F.filter(bounds, lambda x: x <= F.col("doc_id")))
    coarse = F.greatest(below(F.array(*(F.lit(x[0]) for x in fine))) - 1, F.lit(0))
    table = F.array(*(F.array(*map(F.lit, x)) for x in fine))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(coarse * step + below(F.get(table, coarse)))


def with_next(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` (doc_id, text and more) with ``next_<column>`` of the next row in ascending order of doc_id (null ids first,
    equal ids by text); after the last comes the first.

    Ranges of ids are ordered side by side. Each also holds, marked, the rows of the least id of the range after it, so
    the last row of a range finds its successor in its own window and no task sees all rows.
    """
    placed = docs.withColumn("__range", _ranges(docs.select("doc_id"), RANGES * shuffle_partitions(docs.sparkSession)).cast("int"))
    least = placed.groupBy("__range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("id"))
    # one row for each range
    order = Window.orderBy("__range")
    before = least.select(F.col("id.doc_id").alias("__id"), F.col("__range").alias("__of"), F.coalesce(F.lag("__range").over(order), F.max("__range").over(Window.partitionBy())).alias("__before"))
    ghosts = placed.join(F.broadcast(before), (F.col("__range") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    ghosts = ghosts.withColumn("__range", F.col("__before")).drop("__id", "__of", "__before").withColumn("__ghost", F.lit(True))
    rows = placed.withColumn("__ghost", F.lit(False)).unionByName(ghosts)
    window = Window.partitionBy("__range").orderBy("__ghost", F.col("doc_id").asc_nulls_first(), "text")
    return rows.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns}).where(~F.col("__ghost")).drop("__ghost", "__range")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id and fingerprint (a null text is empty: the empty string)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_entries(plain, "text", "entries").select("doc_id", as_string(F.col("entries")).alias("fingerprint"))


def edit_sensitivity(docs: DataFrame) -> DataFrame:
    """How fingerprints follow an edit of half a text, and how they tell it from the next document.

    One row for each row of ``docs``: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text has its last half (rounded down) replaced by the first as many code points
    of the next document (all if there are fewer) in ascending order of doc_id; after the last comes the first. A null
    text is empty; null ids come first and equal ids are ordered by text. A single document is its own next one. An
    empty table gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = with_next(with_entries(plain, "text", "entries"), "text", "entries")
    n = F.char_length("text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("next_text").substr(F.lit(1), half))
    rows = ordered.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).drop("text", "next_text")
    rows = with_entries(rows, "edited", "edited_entries")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("entries")).alias("fingerprint"),
        as_string(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
    )
