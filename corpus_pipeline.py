"""A corpus pipeline of five stages; each works on all documents that its predecessor kept.

1. Language identification: documents without a language (null texts, texts without a letter, texts whose best language
   holds too small a share) go.
2. Near-duplicate removal: one document of each group of exact or near copies stays.
3. Benchmark decontamination: contaminated documents go.
4. Personal data: validated numbers, dates, mail addresses and secrets become pseudonyms; every document stays.
5. BPE: every document's token ids with its text as decoded from them.

The language model is fitted on the stage's own input, without held-out documents. SQL expresses neither the language
model nor the tokenizer, so there is no oracle; the tests compare the stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martlake.llm import bpe, decontamination, language, pii, simhash
from martlake.llm.common import release, settled
from martlake.llm.queries import table, tokenizer


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, pii.key_of(spark))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), text (decoded from the ids)."""
    return bpe.encode_and_decode(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", pseudonymise),
    ("bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; the result of each is written and read again, and deleted once the next is."""
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        release(*done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
