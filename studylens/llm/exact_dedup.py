"""Exact dedup by progressive refinement, DataFrame functions only.

Groups are refined by length, then by the hash of a short prefix, then by the full
SHA-256.  Each level keeps only rows whose group has at least two members, so the
full hash is grouped for rows that length and prefix could not tell apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize

#: Characters of the normalised text that the second level hashes.
PREFIX_CHARS = 128
SEPARATORS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of ASCII separators becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " ")


def _survivors(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows whose key occurs more than once.

    The repeated keys are counted with map-side combine and written, so both join
    sides are plain exchanges and adaptive execution splits a key that a third of
    the rows share.
    """
    repeated = materialize(rows.groupBy(*keys).count().filter("count > 1").select(*keys), name)
    return rows.join(repeated, keys, "left_semi")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts equal each other.  Of equal texts the
    smallest id stays.  Repeated rows of one id stay separate rows (``kept`` is true
    for all rows of the kept id).  An empty table gives an empty table; other
    columns of the input are ignored.  Rows without an id are grouped like others, and
    a group of such rows alone has a null keep_id.

    The first scan emits only (id, length, prefix hash).  The second scan hashes the
    content in place, so no text is ever shuffled; the digest is a result column for
    every row, but only rows that survive both cheap levels are grouped by it.
    """
    text = normalised(F.col(text_col))
    id_ = F.col(id_col).cast("long").alias("doc_id")
    keyed = materialize(
        docs.select(id_, F.octet_length(text).cast("long").alias("n"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix")),
        "dedup-keys",
    )
    by_length = materialize(_survivors(keyed, ["n"], "dedup-length"), "dedup-level1")
    by_prefix = _survivors(by_length, ["n", "prefix"], "dedup-prefix")
    candidates = materialize(by_prefix.select("doc_id").distinct(), "dedup-level2")

    digests = materialize(docs.select(id_, F.unhex(F.sha2(text, 256)).alias("full")), "dedup-digests")
    at = F.col("doc_id").eqNullSafe(F.col("candidate"))
    suspects = digests.join(candidates.select(F.col("doc_id").alias("candidate")), at, "left_semi")
    groups = materialize(suspects.groupBy("full").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"), "dedup-groups")
    return digests.join(groups, "full", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")) | F.col("group_size").isNull(), F.lit(True)).alias("kept"),
        F.lower(F.hex("full")).alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""
