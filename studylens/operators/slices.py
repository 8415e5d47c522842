"""Slices, selectors, label unions and compositions of other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import real_text
from ..functions.rank import rank_by_range
from . import classroom, daily, evidence, paths, ratings

CANONICAL = r"^M\d+$"


def bottleneck_scope(attempts: DataFrame, level: str, objective_id: str | None = None, activity_id: str | None = None, modules: list[str] | None = None) -> DataFrame:
    """FLT-3: canonical modules only; the objective counts below module level, the activity at its own."""
    out = attempts.filter(F.col("module_code").rlike(CANONICAL))
    if modules is not None:
        out = out.filter(F.col("module_code").isin(*modules)) if modules else out.filter(F.lit(False))
    if level in ("objective", "activity") and objective_id:
        out = out.filter(F.col("objective_id") == objective_id)
    if level == "activity" and activity_id:
        out = out.filter(F.col("activity_id") == activity_id)
    return out


def exposure_scope(attempts: DataFrame, module_code: str | None = None, classroom_id: str | None = None, playlist: str | None = None) -> DataFrame:
    """FLT-6: optional module, classroom and playlist; ``all`` and the synthetic classroom mean none."""
    out = attempts
    if module_code:
        out = out.filter(F.col("module_code") == module_code)
    if classroom_id and classroom_id not in ("all", classroom.ALL_STUDENTS):
        out = out.filter(F.col("classroom_id") == classroom_id)
    if playlist:
        out = out.filter((F.col("work_mode") == "playlist") & (F.col("playlist_or_module_id") == playlist))
    return out


def scope_values(attempts: DataFrame, column: str) -> DataFrame:
    """FLT-6, MTX-9: distinct non-blank values of a column in scope, with attempts."""
    return attempts.filter(real_text(F.col(column)).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("attempts"))


def by_id(rows: DataFrame, column: str, value: str, eligible: str | None = None) -> DataFrame:
    """SEL-4: rows of one id, if eligible."""
    out = rows.filter(F.col(column) == value)
    return out.filter(F.col(eligible)) if eligible else out


def first_wins(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """JN-6, SET-1, SET-2: union with missing columns; of rows with one key the earliest frame's stays.

    Inside a frame the smallest row (by all columns) stays.
    """
    out = None
    for i, frame in enumerate(frames):
        part = frame.withColumn("_priority", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    others = [c for c in out.columns if c not in (*key, "_priority")]
    w = Window.partitionBy(*key).orderBy("_priority", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in others])
    return out.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_priority")


def rating_table(base: DataFrame, items: DataFrame, calibration: DataFrame) -> DataFrame:
    """ELO-2, ELO-7: every exercise with its rating if calibrated, attempts filled with 0."""
    keys = ratings.item_columns(items)
    seen = calibration.groupBy(*keys).agg(F.count("*").alias("calibration_attempts"), F.avg("y").alias("calibration_success_rate"))
    out = base
    for table, name in ((items, "rating"), (seen.withColumnRenamed("calibration_attempts", "rating"), "calibration_attempts"), (seen.withColumnRenamed("calibration_success_rate", "rating"), "calibration_success_rate")):
        out = ratings.with_rating(out, table.select(*keys, "rating"), name, "left")
    done = F.coalesce(F.col("calibration_attempts"), F.lit(0)) > 0
    return out.select(
        *base.columns, F.when(done, F.col("rating")).alias("exercise_elo"), F.coalesce("calibration_attempts", F.lit(0)).alias("calibration_attempts"),
        "calibration_success_rate", done.alias("calibrated"), F.lit("unknown").alias("exercise_type"),
    )


def path_findings(attempts: DataFrame) -> DataFrame:
    """WIN-10: ranked full first-visit paths with share, entry activity and dominance class."""
    routes = paths.first_visit_paths(attempts)
    out = routes.groupBy("path").agg(F.count("*").alias("student_count"), F.max("path_length").alias("path_length"))
    total = routes.agg(F.count("*").alias("students"))
    out = out.join(F.broadcast(total)).withColumn("student_share", F.col("student_count") / F.col("students")).withColumn("entry_activity", F.substring_index("path", ">", 1))
    kind = F.when(F.col("student_share") >= 0.5, "dominant").when(F.col("student_share") >= 0.2, "common").otherwise("rare")
    return rank_by_range(out, F.desc("student_count"), F.asc("path")).withColumn("dominance", kind).drop("students")


def entry_activities(attempts: DataFrame) -> DataFrame:
    """WIN-10: how many students start with each activity."""
    first = paths.first_visits(attempts).filter("step = 1")
    total = first.agg(F.count("*").alias("_n"))
    return first.groupBy("activity_id").agg(F.count("*").alias("student_count")).join(F.broadcast(total)).select("activity_id", "student_count", (F.col("student_count") / F.col("_n")).alias("student_share"))


def population_trajectories(attempts: DataFrame, least: int = 1, min_run: int = 1) -> DataFrame:
    """WIN-15: trajectories of zpdes and playlist attempts by population, after the playlist filter."""
    rows = evidence.single_module_playlists(attempts).filter("work_mode in ('zpdes', 'playlist')")
    split = evidence.population_split(rows, least=least).select("user_id", "population")
    return paths.trajectories(rows, min_run=min_run).join(split, "user_id")


def population_audit(trajectories: DataFrame) -> DataFrame:
    """WIN-15: students, runs, attempts and mean run length per population and mode."""
    runs = trajectories.groupBy("population", "work_mode", "user_id", "run").agg(F.max("run_length").alias("n"))
    return runs.groupBy("population", "work_mode").agg(F.count_distinct("user_id").alias("students"), F.count("*").alias("runs"), F.sum("n").alias("attempts"), F.avg("n").alias("mean_run_length"))


def sliced_ordinals(attempts: DataFrame) -> DataFrame:
    """WIN-5: ordinals of a filtered fact: a student's attempts in the slice, by time and then mode."""
    w = Window.partitionBy("user_id").orderBy("created_at", "work_mode", "event_id")
    return attempts.withColumn("student_attempt_index", F.row_number().over(w))


def sliced_work_mode_paths(attempts: DataFrame, least: int = 1, **scope) -> DataFrame:
    """WIN-4, WIN-5: work-mode paths within a slice; ``scope`` as of ``daily.slice_attempts``."""
    rows = daily.min_attempts_slice(daily.slice_attempts(attempts, **scope), least)
    return paths.work_mode_paths(sliced_ordinals(rows))


def of_students(rows: DataFrame, students: DataFrame, module_code: str | None = None, mode: str | None = None) -> DataFrame:
    """FLT-4: rows of some students (user_id; blank ids are none), in one module and mode if given; ``all`` is no mode."""
    wanted = students.select(F.trim("user_id").alias("user_id")).filter("user_id <> ''").distinct()
    out = rows.join(wanted, "user_id", "left_semi")
    if module_code and module_code.strip():
        out = out.filter(F.col("module_code") == module_code.strip())
    return out.filter(F.col("work_mode") == mode) if mode and mode != "all" else out


def student_places(attempts: DataFrame, students: DataFrame, module_code: str | None = None) -> DataFrame:
    """FLT-4: labels of the places that some students met, one row per activity, objective and module."""
    rows = of_students(attempts, students, module_code).filter("activity_id is not null and objective_id is not null and module_code is not null")
    return rows.groupBy("activity_id", "objective_id", "module_code").agg(*[F.min(c).alias(c) for c in ("module_label", "objective_label", "activity_label")])


def classroom_slice(attempts: DataFrame, **scope) -> tuple[DataFrame, DataFrame]:
    """CLS-5: classroom profiles and activity summary rebuilt on a filtered slice."""
    rows = exposure_scope(attempts, **scope)
    return daily.classroom_mode_profiles(rows), daily.classroom_activity_summary(rows)
