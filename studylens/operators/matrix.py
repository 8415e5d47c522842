"""Objective x activity cells, their order and exercise drill-down."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import rate, real_text, success, trimmed, two_proportion_z, two_sided_p
from .ratings import with_rating

METRICS = ("attempts", "success_rate", "exercise_balanced_success_rate", "activity_mean_exercise_elo", "repeat_attempt_rate", "first_attempt_success_rate", "playlist_unique_exercises")
CELL = ["module_code", "objective_id", "objective_label", "activity_id", "activity_label"]


def cells(attempts: DataFrame, metric: str, ratings: DataFrame | None = None, mode: str | None = None) -> DataFrame:
    """MTX-1, MTX-2, MTX-3: one value per objective and activity, 0 without attempts.

    Attempts without objective or activity have no cell.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    rows = attempts.filter(F.col("work_mode") == mode) if mode else attempts
    for c in ("objective_id", "activity_id"):
        rows = rows.filter(real_text(F.col(c)).isNotNull() & (trimmed(F.col(c)) != "None"))
    if metric == "exercise_balanced_success_rate":
        return rows.groupBy(*CELL, "exercise_id").agg(rate(success()).alias("r")).groupBy(*CELL).agg(F.avg("r").alias("metric_value"))
    if metric == "activity_mean_exercise_elo":
        seen = rows.select(*CELL, "exercise_id").distinct()
        return with_rating(seen, ratings, "rating", "left").groupBy(*CELL).agg(F.avg("rating").alias("metric_value"))
    first = F.col("attempt_number") == 1
    value = {
        "attempts": F.count("*").cast("double"),
        "success_rate": rate(success()),
        "repeat_attempt_rate": rate((F.col("attempt_number") > 1).cast("int")),
        "first_attempt_success_rate": rate(F.when(first, success())),
        "playlist_unique_exercises": F.count_distinct(F.when(F.col("work_mode") == "playlist", F.col("exercise_id"))).cast("double"),
    }[metric]
    return rows.groupBy(*CELL).agg(F.coalesce(value, F.lit(0.0)).alias("metric_value"))


def ordered(matrix: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """MTX-4: row and column positions: catalog order, then label and id; columns are A1, A2, ...

    ``catalog`` has activity_id, objective_order and activity_order.
    """
    if catalog is None:
        rows = matrix.withColumns({"objective_order": F.lit(None).cast("int"), "activity_order": F.lit(None).cast("int")})
    else:
        rows = matrix.join(catalog.select("activity_id", "objective_order", "activity_order"), "activity_id", "left")
    big = F.lit(2**31 - 1)
    objectives = rows.groupBy("module_code", "objective_id", "objective_label").agg(F.coalesce(F.min("objective_order"), big).alias("_o"))
    objectives = objectives.withColumn("row_idx", F.row_number().over(Window.partitionBy("module_code").orderBy("_o", F.lower("objective_label"), "objective_id")))
    same = F.count("*").over(Window.partitionBy("module_code", "objective_label"))
    objectives = objectives.withColumn("objective_row_label", F.when(same > 1, F.concat("objective_label", F.lit(" ["), F.substring("objective_id", 1, 8), F.lit("]"))).otherwise(F.col("objective_label")))
    column = F.row_number().over(Window.partitionBy("module_code", "objective_id").orderBy(F.coalesce("activity_order", big), F.lower("activity_label"), "activity_id"))
    rows = rows.withColumn("activity_col_idx", column).withColumn("activity_col_label", F.concat(F.lit("A"), F.col("activity_col_idx").cast("string")))
    return rows.join(objectives.select("module_code", "objective_id", "row_idx", "objective_row_label"), ["module_code", "objective_id"]).select(*CELL, "objective_row_label", "row_idx", "activity_col_idx", "activity_col_label", "metric_value")


def wide(matrix: DataFrame, columns: int) -> DataFrame:
    """MTX-5: ragged rows as one column per position."""
    return matrix.groupBy("module_code", "objective_id", "objective_row_label").pivot("activity_col_label", [f"A{i + 1}" for i in range(columns)]).agg(F.first("metric_value"))


def drilldown(attempts: DataFrame, metric: str = "success_rate", mode: str | None = None, ratings: DataFrame | None = None) -> DataFrame:
    """MTX-6: exercises of every cell with value, support and text; of one work mode if given.

    ``playlist_unique_exercises`` lists the exercises that playlists reached, with their
    playlist attempts; ``activity_mean_exercise_elo`` shows each exercise's rating.
    """
    if mode or metric == "playlist_unique_exercises":
        attempts = attempts.filter(F.col("work_mode") == (mode or "playlist"))
    if metric == "activity_mean_exercise_elo":
        seen = attempts.groupBy("module_code", "objective_id", "activity_id", "exercise_id").agg(F.count("*").alias("attempts"))
        return with_rating(seen, ratings, "metric_value", "left").withColumn("metric_text", F.coalesce(F.bround("metric_value").cast("long").cast("string"), F.lit("not calibrated")))
    text = {"attempts": F.format_string("%d attempts", "attempts"), "playlist_unique_exercises": F.format_string("%d playlist attempts", "attempts")}.get(metric, F.concat(F.round(F.col("metric_value") * 100, 1).cast("string"), F.lit("%")))
    value = {
        "attempts": F.count("*").cast("double"),
        "playlist_unique_exercises": F.lit(1.0),
        "success_rate": rate(success()),
        "repeat_attempt_rate": rate((F.col("attempt_number") > 1).cast("int")),
        "first_attempt_success_rate": rate(F.when(F.col("attempt_number") == 1, success())),
    }[metric]
    return attempts.groupBy("module_code", "objective_id", "activity_id", "exercise_id").agg(F.count("*").alias("attempts"), value.alias("metric_value")).withColumn("metric_text", text)


def matrix_findings(matrix: DataFrame) -> DataFrame:
    """MTX-8: per objective mean, spread and extremes, early against late half of positions."""
    half = F.max("activity_col_idx").over(Window.partitionBy("module_code", "objective_id"))
    rows = matrix.withColumn("_early", F.col("activity_col_idx") <= half / 2)
    return rows.groupBy("module_code", "objective_id").agg(
        F.count("*").alias("activities"),
        F.avg("metric_value").alias("mean_value"),
        (F.max("metric_value") - F.min("metric_value")).alias("spread"),
        F.max_by("activity_id", F.struct("metric_value", "activity_id")).alias("highest_activity"),
        F.min_by("activity_id", F.struct("metric_value", "activity_id")).alias("lowest_activity"),
        (F.avg(F.when(~F.col("_early"), F.col("metric_value"))) - F.avg(F.when(F.col("_early"), F.col("metric_value")))).alias("late_minus_early"),
    )


#: Attempts (or calibration attempts) from which an exercise is compared.
MIN_SUPPORT = 10


def drilldown_findings(exercises: DataFrame, metric: str, support: str = "attempts", listed: int = 5) -> DataFrame:
    """MTX-8: extremes of every cell's exercises, their spread, a verdict, a ranking and a test of the gap.

    ``exercises`` is a drill-down of ``metric``.  Exercises below MIN_SUPPORT or without a
    value are left out, cells with fewer than two others too.  Order: value falling, then
    support falling, then id.  Rates of which low is worse list the lowest first; for
    them and success counts rounded from the rate, the highest and lowest exercise are
    tested as two proportions.  A cell is uneven from a spread of 0.2 (rates), 20
    (counts) or 120 (ratings) on.
    """
    counts, low_is_worse = metric in ("attempts", "playlist_unique_exercises"), metric in ("success_rate", "exercise_balanced_success_rate", "first_attempt_success_rate")
    value = F.col("attempts").cast("double") if counts else F.col("metric_value")
    rows = exercises.withColumn("_v", value).filter((F.coalesce(F.col(support), F.lit(0)) >= MIN_SUPPORT) & F.col("_v").isNotNull())
    falling = F.struct((-F.col("_v")).alias("v"), (-F.col(support)).alias("n"), F.col("exercise_id").alias("id"))
    rising = F.struct(F.col("_v").alias("v"), (-F.col(support)).alias("n"), F.col("exercise_id").alias("id"))
    shown = rising if low_is_worse else falling
    item = F.struct("exercise_id", F.col("_v").alias("v"), F.col(support).cast("long").alias("n"))
    cell = [c for c in ("module_code", "objective_id", "activity_id") if c in exercises.columns]
    out = rows.groupBy(*cell).agg(
        F.count("*").alias("exercises"), F.min_by(item, falling).alias("top"), F.max_by(item, falling).alias("bottom"),
        F.concat_ws(">", F.transform(F.slice(F.array_sort(F.collect_list(shown)), 1, listed), lambda x: x["id"])).alias("ranking"),
    ).filter("exercises >= 2")
    spread = F.abs(F.col("top.v") - F.col("bottom.v"))
    limit = 20 if counts else 120 if metric == "activity_mean_exercise_elo" else 0.20
    hits = {x: F.bround(F.col(f"{x}.v") * F.col(f"{x}.n")) for x in ("top", "bottom")}
    z = two_proportion_z(hits["top"], F.col("top.n"), hits["bottom"], F.col("bottom.n")) if low_is_worse else F.lit(None).cast("double")
    return out.select(
        *cell, "exercises", F.col("top.exercise_id").alias("highest_exercise"), F.col("top.v").alias("highest_value"), F.col("bottom.exercise_id").alias("lowest_exercise"), F.col("bottom.v").alias("lowest_value"),
        spread.alias("spread"), F.when(spread >= limit, "uneven").otherwise("even").alias("finding"), "ranking", z.alias("z"), two_sided_p(z).alias("p_value"),
    )
