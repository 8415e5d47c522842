"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes the whole table that its predecessor kept, as (spark, docs, sf_dir), and
is written to the shared folder before the next one reads it.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from studylens.llm.common import documents, materialize
from studylens.llm.exact_dedup import exact_dedup
from studylens.llm.minhash import minhash_dedup
from studylens.llm.packing import pack_documents
from studylens.llm.substring_dedup import substring_dedup
from studylens.llm.toxicity import drop_toxic, fit, labelled_sample


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score above the cut go; model and cut are fitted on labelled documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, fit(*labelled_sample(documents(docs), labels)))


def _one_of_each(docs: DataFrame, name: str, group: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``docs`` with one row of every group: the smallest doc_id, rows without id last.

    ``group(rows, key)`` tells the group of every row by ``key``, a number that is written
    with the rows, so ids that are missing, repeated or shared by different texts don't
    matter and exact repeats of a row leave one.  Rows that go grow with the corpus, so
    they meet the documents in a shuffle.
    """
    key = "row"
    while key in docs.columns:
        key += "_"
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()), f"{name}-rows")
    groups = materialize(group(rows, key).select(F.col("doc_id").alias(key), "group"), f"{name}-groups")
    shared = groups.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").select("group")
    members = materialize(groups.join(shared, "group", "left_semi").join(rows.select(key, F.col("doc_id").alias("id")), key), f"{name}-members")
    best = members.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", key)).alias("best")).select(F.col(f"best.{key}").alias(key))
    gone = members.select(key).join(best, key, "left_anti")
    return rows.join(gone.hint("merge"), key, "left_anti").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, as ``exact_dedup`` has them, one row stays: the one with the smallest doc_id.

    Null and empty texts equal each other.  Of rows that repeat an id and a text, or have
    no id, one stays too; different texts of one id are judged apart.
    """
    return _one_of_each(docs, "exact", lambda rows, key: exact_dedup(rows, id_col=key).withColumnRenamed("keep_id", "group"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8) one row stays, as in ``exact``.

    Texts without words are linked with nothing and all stay.
    """
    return _one_of_each(docs, "near", lambda rows, key: minhash_dedup(rows, id_col=key, shingle=5, percent=80).withColumnRenamed("component_id", "group"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated 35-word windows leave the texts; all rows stay, in their other columns unchanged.

    Null texts become empty.  A row that repeats id and text repeats all its windows.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    kept = substring_dedup(docs, verbatim=True, keep=others).withColumnRenamed("kept_text", "text")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places; null and empty texts are the end mark alone."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("substring_dedup", substrings),
    ("packing", packing),
]

#: No stage after the first can be expressed in SQL on the first one's result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
