"""The registered queries of this subpackage; each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlake.llm import bpe, content_sort, decontamination, hard_negatives, importance, language, language_model, order_minhash, pii, simhash, substrings, token_counts, token_files
from martlake.llm.common import stage_path


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one in fewer parts than there are cores is dealt out, as the operators work far longer than they read."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if name == "documents" and found.rdd.getNumPartitions() < cores else found


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "token-files")
    token_files.write_ids(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"))
    return token_files.read_documents(spark, path)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_sensitivity(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"), pii.key_of(spark))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), F.col("embedding").alias("vector")))


def op12_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.find_copies(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_language": op2_language,
    "op3_substrings": op3_substrings,
    "op4_token_counts": op4_token_counts,
    "op5_token_files": op5_token_files,
    "op6_simhash": op6_simhash,
    "op7_bpe": op7_bpe,
    "op8_order_minhash": op8_order_minhash,
    "op9_pii": op9_pii,
    "op10_language_model": op10_language_model,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_content_sort": op12_content_sort,
    "op13_importance_resampling": op13_importance_resampling,
}

OP1_SQL = r"""
WITH folded AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL
), sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0
), windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM sized)
), lengths AS (SELECT DISTINCT n FROM sized
), rolled AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM folded, lengths WHERE len(w) >= n)
), hits AS (SELECT r, n, k, item_id FROM rolled JOIN windows USING (n, g)
), words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, n, k FROM hits)) GROUP BY r
), listed AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM folded LEFT JOIN words USING (r) LEFT JOIN listed USING (r)
"""

OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (SELECT r, k, array_to_string(w[k : k + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)
), repeated AS (SELECT r, k FROM windows JOIN (SELECT g FROM windows GROUP BY g HAVING count(*) > 1) USING (g)
), gone AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS p FROM repeated
), words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

OP11_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS o, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), p AS (SELECT r, o, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.r = p.r AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.r, p.o ORDER BY s.score DESC, s.vec_id NULLS LAST) QUALIFY row_number() OVER w <= 3
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents
), best AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size FROM d WINDOW w AS (PARTITION BY k ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(k) AS text_sha256 FROM best
"""

# CRC-32 by half bytes: the table for four bits, from the polynomial
_NIBBLES = ", ".join(str(reduce(lambda c, _: (c >> 1) ^ (0xEDB88320 if c & 1 else 0), range(4), n)) for n in range(16))
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, true AS source FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark
), w AS (SELECT r, doc_id, source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d
), f AS (SELECT r, source, array_to_string(w[k : k + n - 1], ' ') AS f, count(*) AS c FROM (SELECT r, source, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM w, (VALUES (1), (2), (3)) t(n) WHERE len(w) >= n) GROUP BY ALL
), h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)
), b AS (SELECT f, xor(list_reduce(list_transform(range(1, len(x) + 1), lambda i: CAST(strpos('0123456789ABCDEF', x[i + (i % 2) * 2 - 1]) - 1 AS BIGINT)),
    lambda c, z: xor(c >> 4, [{_NIBBLES}][(xor(c, z) & 15) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS b FROM h
), t AS (SELECT r, source, b, sum(c) AS c FROM f JOIN b USING (f) GROUP BY ALL
), g AS (SELECT b, CAST(coalesce(sum(c) FILTER (WHERE source), 0) AS DOUBLE) AS s, CAST(coalesce(sum(c) FILTER (WHERE NOT source), 0) AS DOUBLE) AS t FROM t GROUP BY b
), n AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM g
), gain AS (SELECT b, floor(1000 * ln(((g.t + 1) * (n.s + 10000)) / ((g.s + 1) * (n.t + 10000)))) AS gain FROM g, n
), weight AS (SELECT r, CAST(sum(c * gain) AS BIGINT) AS weight, CAST(sum(c) AS BIGINT) AS n FROM t JOIN gain USING (b) WHERE source GROUP BY r
), scored AS (SELECT r, doc_id, len(w) >= 20 AS fit, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
    FROM w LEFT JOIN weight USING (r) WHERE source
), ranked AS (SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, doc_id NULLS LAST) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= (SELECT count(*) FILTER (WHERE fit) * 5 // 100 FROM scored) THEN place END AS rank FROM ranked
"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL, "op3_substrings": OP3_SQL, "op11_hard_negatives": OP11_SQL, "op12_content_sort": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
