"""Concentration of attempts over entities and students."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import real_text
from ..functions.rank import decile_by_cutoffs, decile_by_floor, rank_by_count

LEVELS = {"exercise": ("exercise_id", "exercise_id"), "activity": ("activity_id", "activity_label"), "objective": ("objective_id", "objective_label"), "module": ("module_code", "module_label")}


def entities(attempts: DataFrame, level: str, modes: tuple[str, ...] = (), catalog: DataFrame | None = None) -> DataFrame:
    """CON-1: attempts, share, contained exercises and label of every entity of a level.

    ``catalog`` (id, label, exercises) wins over the attempts for contained exercises;
    entities seen only in the initial test without a label are named as unmapped.
    """
    id_, label = LEVELS[level]
    rows = attempts.filter(F.col("work_mode").isin(*modes)) if modes else attempts
    out = rows.filter(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("id")).agg(
        F.count("*").alias("attempts"),
        F.count_distinct("exercise_id").alias("_seen"),
        F.max(real_text(F.col(label))).alias("_label"),
        F.max("module_code").alias("_module"),
        F.min(F.col("work_mode") == "initial-test").alias("_initial"),
    )
    if catalog is not None:
        out = out.join(catalog.select("id", F.col("label").alias("_named"), F.col("exercises").alias("_listed")), "id", "left")
    else:
        out = out.withColumns({"_named": F.lit(None).cast("string"), "_listed": F.lit(None).cast("long")})
    unmapped = F.when(F.col("_initial"), F.concat(F.lit(f"Unmapped initial-test {level} ("), F.coalesce("_module", F.lit("-")), F.lit(")")))
    total = rows.filter(F.col(id_).isNotNull()).agg(F.count("*").alias("_total"))
    return out.join(F.broadcast(total)).select(
        "id",
        F.coalesce("_label", "_named", unmapped, "id").alias("label"),
        "attempts",
        (F.col("attempts") / F.col("_total")).alias("attempt_share"),
        F.coalesce(F.col("_listed"), F.when(F.col("_seen") > 0, F.col("_seen")), F.lit(1)).alias("contained_exercises"),
    )


def with_deciles(rows: DataFrame, id_: str = "id") -> DataFrame:
    """CON-2: rank by attempts and decile by ceil cut-offs."""
    return rank_by_count(rows, "attempts", id_).withColumn("bucket", decile_by_cutoffs(F.col("rank"), F.col("rank_n"))).drop("rank_n")


def students(attempts: DataFrame) -> DataFrame:
    """CON-3: students with attempts, uniques, rank and decile."""
    rows = attempts.filter(real_text(F.col("user_id")).isNotNull()).groupBy("user_id").agg(F.count("*").alias("attempts"), F.count_distinct("exercise_id").alias("unique_exercises"), F.count_distinct("activity_id").alias("unique_activities"))
    total = rows.agg(F.sum("attempts").alias("_total"))
    return with_deciles(rows, "user_id").join(F.broadcast(total)).withColumn("attempt_share", F.col("attempts") / F.col("_total")).drop("_total")


def bucket_summary(rows: DataFrame) -> DataFrame:
    """CON-5: attempts, share and entities per bucket."""
    return rows.groupBy("bucket").agg(F.sum("attempts").alias("attempts"), F.sum("attempt_share").alias("attempt_share"), F.count("*").alias("entity_count"))


def within_entities(attempts: DataFrame, level: str) -> DataFrame:
    """CON-4: per entity, attempts and share of each tenth of its students; empty tenths are 0."""
    id_ = LEVELS[level][0]
    rows = attempts.filter(real_text(F.col("user_id")).isNotNull() & F.col(id_).isNotNull())
    per = rows.groupBy(F.col(id_).alias("id"), "user_id").agg(F.count("*").alias("attempts"))
    ranked = rank_by_count(per, "attempts", "user_id", within=["id"]).withColumn("bucket", decile_by_floor(F.col("rank"), F.col("rank_n")))
    filled = ranked.groupBy("id", "bucket").agg(F.sum("attempts").alias("attempts"), F.count("*").alias("students"))
    total = per.groupBy("id").agg(F.sum("attempts").alias("_total"), F.count("*").alias("unique_students"))
    grid = total.withColumn("bucket", F.explode(F.sequence(F.lit(1), F.lit(10))))
    out = grid.join(filled, ["id", "bucket"], "left")
    return out.select("id", "bucket", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("students", F.lit(0)).alias("students"), "unique_students", (F.coalesce("attempts", F.lit(0)) / F.col("_total")).alias("attempt_share"))


def top_student_share(within: DataFrame) -> DataFrame:
    """CON-4: share of the first tenth of students per entity."""
    return within.filter("bucket = 1").select("id", F.col("attempt_share").alias("top_10_students_share"), "unique_students")


def concentration_findings(rows: DataFrame) -> DataFrame:
    """CON-6: cumulative shares of the top 10, 20, 30 and 50 %, median attempts and a class."""
    part = lambda k: F.sum(F.when(F.col("bucket") <= k, F.col("attempt_share")).otherwise(0.0))
    out = rows.agg(*[part(k).alias(f"top_{k}0_share") for k in (1, 2, 3, 5)], F.median("attempts").alias("median_attempts"), F.count("*").alias("entities"))
    kind = F.when(F.col("top_10_share") >= 0.5, "high").when(F.col("top_20_share") >= 0.5, "moderate").otherwise("low")
    return out.withColumn("concentration", kind)
