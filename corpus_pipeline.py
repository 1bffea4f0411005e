"""A training corpus from raw documents: language ID, near duplicates, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a DataFrame; run() writes each to
the shared folder as Parquet and reads it again. All but the last return the columns of documents. Nulls: a null text has no language
and goes in the first stage; rows with a null id, and rows that share one, are documents of their own; a null source is a source. Very long texts are read whole in
every stage. Ties: of near duplicates with one id the least digest of the text stays, and rows of one id and size keep the order of their digests in the mix; repeated rows are near duplicates of each other. An empty table gives
an empty result. Columns besides those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreal.llm import bpe, langid, mixing, ngram_join, substring_dedup
from boreal.llm.common import release, stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if one language makes up this share of it.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that makes up half of them, go."""
    langs, prob = langid.learned_from(docs)
    found = langid.predict(docs.select(*COLUMNS), langs, prob)
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each connected group of similar rows stays: the one with the least id, null last; of rows that share it, the one with the least digest of its text."""
    rows = stage(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")
    found = ngram_join.similarity_join(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "class_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.sha1("text").alias("digest"), "row")
    kept = found.join(rows.select("row", order.alias("order")), "row").groupBy("class_id").agg(F.min("order").alias("order")).select("order.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated passages go, and documents of which nothing is left."""
    found = substring_dedup.deduplicate(docs.select(*COLUMNS)).filter("n_removed = 0 OR n_removed < n_words")
    return found.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, or as far, as the mix takes them."""
    return mixing.mixed(docs.select(*COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of every document of the mix."""
    return bpe.encode(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", token_ids),
]

#: SQL can express neither the trained first stage nor the merges of the last; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
        release(spark)
    return docs
