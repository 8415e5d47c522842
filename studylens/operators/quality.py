"""Data-quality checks of attempts, catalogs and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table_counts(df: DataFrame, time: str = "created_at") -> DataFrame:
    """DQ-1: rows, columns, first and last time, nulls of every column in one row."""
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), F.min(time).alias("first_at"), F.max(time).alias("last_at"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns])


def missing_references(attempts: DataFrame, catalog: DataFrame) -> DataFrame:
    """DQ-2, SET-4: ids of attempts that the catalog lacks, by level, with attempts."""
    out = None
    for level in ("objective_id", "activity_id", "exercise_id"):
        part = attempts.filter(F.col(level).isNotNull()).join(catalog.select(level).distinct(), level, "left_anti").groupBy(F.col(level).alias("id")).agg(F.count("*").alias("attempts")).select(F.lit(level).alias("level"), "id", "attempts")
        out = part if out is None else out.unionByName(part)
    return out


def unattempted(attempts: DataFrame, catalog: DataFrame) -> DataFrame:
    """DQ-2: catalog exercises without attempts."""
    return catalog.select("exercise_id").filter("exercise_id is not null").distinct().join(attempts.select("exercise_id").distinct(), "exercise_id", "left_anti")


def health(catalog: DataFrame) -> DataFrame:
    """DQ-3: counters of a nested catalog row."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return catalog.select(size("modules").alias("modules"), size("id_label_index").alias("labels"), size("exercise_to_hierarchy").alias("exercises"), size("conflicts").alias("conflicts"), size("orphans").alias("orphans"))


def assertions(df: DataFrame, expected: dict[str, float]) -> DataFrame:
    """DQ-4: one row per check of a one-row frame: name, expected, actual, passed."""
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(v)).alias("expected"), F.col(k).cast("double").alias("actual")) for k, v in expected.items()])).alias("x")
    return df.select(entries).select("x.name", "x.expected", "x.actual", F.col("x.expected").eqNullSafe(F.col("x.actual")).alias("passed"))


def duplicate_ids(hierarchy: DataFrame) -> DataFrame:
    """DQ-5: ids that stand under more than one parent."""
    rows = None
    for level, parent in (("objective_id", "module_id"), ("activity_id", "objective_id"), ("exercise_id", "activity_id")):
        part = hierarchy.filter(F.col(level).isNotNull()).groupBy(F.col(level).alias("id")).agg(F.count_distinct(parent).alias("parents")).filter("parents > 1").select(F.lit(level).alias("level"), "id", "parents")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def nested_against_flat(hierarchy: DataFrame, flat: DataFrame) -> DataFrame:
    """DQ-5: exercises only in the nested catalog or only in the flat map."""
    a, b = hierarchy.select("exercise_id").filter("exercise_id is not null").distinct(), flat.select("exercise_id").distinct()
    return a.join(b, "exercise_id", "left_anti").withColumn("only_in", F.lit("nested")).unionByName(b.join(a, "exercise_id", "left_anti").withColumn("only_in", F.lit("flat")))


def reciprocity(rules: DataFrame) -> DataFrame:
    """DQ-5: pairs of code and id that only one of the two maps has."""
    one = rules.select(F.explode("map_id_code.code_to_id").alias("code", "id"))
    two = rules.select(F.explode("map_id_code.id_to_codes").alias("id", "codes")).select(F.explode("codes").alias("code"), "id")
    return one.exceptAll(two).withColumn("only_in", F.lit("code_to_id")).unionByName(two.exceptAll(one).withColumn("only_in", F.lit("id_to_codes")))


def label_report(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """FLT-8: rows and distinct ids without a label, by level."""
    entries = F.array(*[F.struct(F.lit(i).alias("level"), F.col(i).alias("id"), F.col(label).alias("label")) for i, label in pairs])
    return rows.select(F.explode(entries).alias("x")).filter("x.id is not null and x.label is null").groupBy("x.level").agg(F.count("*").alias("rows"), F.count_distinct("x.id").alias("ids"))


def with_labels(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """FLT-8, JN-11: missing labels and missing label columns are filled from the id."""
    return rows.withColumns({label: F.coalesce(F.col(label), F.col(i)) if label in rows.columns else F.col(i) for i, label in pairs})


def empty_like(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([], df.schema)
