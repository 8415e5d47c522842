"""Daily and usage aggregates of attempts.  All are hash aggregates; NULL keys are groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import count_with_null, rate, success, success_or_zero, sum0

HIERARCHY = ["module_id", "module_code", "module_label", "objective_id", "objective_label", "activity_id", "activity_label"]


def attempt_context(attempts: DataFrame) -> DataFrame:
    """AGG-0: success as integer, first-attempt flag and value, retry before any success."""
    earlier = Window.partitionBy("user_id", "exercise_id").orderBy("created_at", "attempt_number").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("attempt_number") == 1
    prior = F.coalesce(F.sum(success_or_zero()).over(earlier), F.lit(0))
    return attempts.withColumns(
        {
            "success": success(),
            "first_attempt_flag": F.when(first, 1).otherwise(0),
            "first_attempt_value": F.when(first, success()),
            "repeat_attempt_flag": (F.col("attempt_number") > 1).cast("int"),
            "retry_before_success_flag": ((F.coalesce("attempt_number", F.lit(1)) > 1) & (prior == 0)).cast("int"),
        }
    )


def _activity_measures() -> list[Column]:
    return [
        F.count("*").alias("attempts"),
        count_with_null("user_id").alias("unique_students"),
        rate(F.col("success")).alias("success_rate"),
        rate(F.col("first_attempt_value")).alias("first_attempt_success_rate"),
        F.sum("first_attempt_flag").alias("first_attempt_count"),
        F.median("data_duration").alias("median_duration"),
        rate(F.col("repeat_attempt_flag")).alias("repeat_attempt_rate"),
        rate(F.col("retry_before_success_flag")).alias("retry_before_success_rate"),
        rate(F.col("attempt_number")).alias("avg_attempt_number"),
    ]


def activity_daily(attempts: DataFrame) -> DataFrame:
    """AGG-1: date x activity with its hierarchy."""
    return attempt_context(attempts).groupBy("date_utc", *HIERARCHY).agg(*_activity_measures())


def exercise_daily(attempts: DataFrame, exercises: DataFrame | None = None) -> DataFrame:
    """AGG-7: date x exercise; label and type from ``exercises``, else the id and "unknown"."""
    daily = attempt_context(attempts).groupBy("date_utc", *HIERARCHY, "exercise_id").agg(*_activity_measures())
    if exercises is None:
        return daily.withColumns({"exercise_label": F.col("exercise_id"), "exercise_type": F.lit("unknown")})
    named = daily.join(exercises.select("exercise_id", "exercise_label", "exercise_type"), "exercise_id", "left")
    return named.withColumns({"exercise_label": F.coalesce("exercise_label", "exercise_id"), "exercise_type": F.coalesce("exercise_type", F.lit("unknown"))})


def objective_daily(attempts: DataFrame) -> DataFrame:
    """AGG-2: date x objective."""
    return attempts.groupBy("date_utc", *HIERARCHY[:5]).agg(
        F.count("*").alias("attempts"),
        count_with_null("user_id").alias("unique_students"),
        rate(success()).alias("success_rate"),
        F.median("data_duration").alias("median_duration"),
        rate((F.col("attempt_number") > 1).cast("int")).alias("repeat_attempt_rate"),
    )


def student_module_progress(attempts: DataFrame) -> DataFrame:
    """AGG-3: date x student x module."""
    return attempts.groupBy("date_utc", "user_id", *HIERARCHY[:3]).agg(
        F.count("*").alias("attempts"),
        count_with_null("activity_id").alias("unique_activities"),
        rate(success()).alias("success_rate"),
        rate(F.col("attempt_number")).alias("avg_attempt_number"),
        F.max("created_at").alias("last_attempt_at"),
    )


def module_usage_daily(attempts: DataFrame) -> DataFrame:
    """AGG-4: date x module."""
    return attempts.groupBy("date_utc", *HIERARCHY[:3]).agg(
        F.count("*").alias("attempts"),
        F.count_distinct("user_id").alias("unique_students"),
        F.count_distinct("playlist_or_module_id").alias("unique_playlists"),
        F.count_distinct("activity_id").alias("unique_activities"),
    )


def playlist_module_usage(attempts: DataFrame) -> DataFrame:
    """AGG-5: playlist x module; rows without module go where the playlist has a module.

    Attempts without a playlist are a group of their own.  A group goes or stays as a whole,
    so that is decided on one row per group.
    """
    keys = ["playlist_or_module_id", *HIERARCHY[:3]]
    per_mode = attempts.groupBy(*keys, "work_mode").agg(F.count("*").alias("n"), F.count(success()).alias("known"), F.sum(success()).alias("won"))
    modes = F.count("work_mode")
    totals = per_mode.groupBy(*keys).agg(
        F.when(modes == 0, "unknown").when(modes == 1, F.max("work_mode")).otherwise("mixed").alias("work_mode"),
        F.sum("n").alias("attempts"),
        (F.sum("won") / F.when(F.sum("known") > 0, F.sum("known"))).alias("success_rate"),
    )
    mapped = F.max(F.col("module_code").isNotNull()).over(Window.partitionBy("playlist_or_module_id"))
    totals = totals.withColumn("mapped", mapped).filter("module_code is not null or not mapped")
    # apart from the largest work_mode, whose text would have every row sorted once per count
    uniques = attempts.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(
        F.count_distinct("user_id").alias("unique_students"),
        F.count_distinct("classroom_id").alias("unique_classrooms"),
        F.count_distinct("activity_id").alias("unique_activities"),
        F.count_distinct("exercise_id").alias("unique_exercises"),
    )
    both = totals.join(uniques, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    return both.select(*keys, "work_mode", "attempts", "unique_students", "unique_classrooms", "unique_activities", "unique_exercises", "success_rate")


def module_activity_usage(attempts: DataFrame) -> DataFrame:
    """AGG-6: activity usage with its share of the module's attempts."""
    usage = attempts.groupBy(*HIERARCHY).agg(F.count("*").alias("attempts"), F.count_distinct("user_id").alias("unique_students"))
    return usage.withColumn("activity_share_within_module", F.col("attempts") / F.sum("attempts").over(Window.partitionBy("module_code")))


def overview_kpi(attempts: DataFrame) -> DataFrame:
    """AGG-12: attempts, students, exercises, mean distinct exercises per student."""
    per_student = attempts.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("exercise_id").alias("exercises"))
    total = attempts.agg(F.count_distinct("exercise_id").alias("unique_exercises"))
    return per_student.agg(F.sum("n").alias("attempts"), F.count("user_id").alias("unique_students"), F.avg("exercises").alias("exercises_per_student")).join(F.broadcast(total))


def work_mode_summary(attempts: DataFrame) -> DataFrame:
    """AGG-13: per mode counts, success, exercise-balanced success, median attempts per activity."""
    totals = attempts.groupBy("work_mode").agg(
        F.count("*").alias("attempts"),
        F.count_distinct("user_id").alias("unique_students"),
        F.count_distinct("exercise_id").alias("unique_exercises"),
        rate(success()).alias("success_rate"),
        rate((F.col("attempt_number") > 1).cast("int")).alias("repeat_attempt_rate"),
    )
    balanced = attempts.groupBy("work_mode", "exercise_id").agg(rate(success()).alias("r")).groupBy("work_mode").agg(F.avg("r").alias("balanced_success_rate"))
    typical = attempts.groupBy("work_mode", "activity_id").count().groupBy("work_mode").agg(F.median("count").alias("median_attempts_per_activity"))
    return totals.join(balanced, "work_mode").join(typical, "work_mode")


def exposure(attempts: DataFrame) -> DataFrame:
    """AGG-14: student x module exposure, buckets of attempts and the effective flag."""
    out = attempts.groupBy("user_id", "module_code").agg(
        F.count("*").alias("attempts"),
        F.count_distinct("activity_id").alias("unique_activities"),
        F.count_distinct("date_utc").alias("active_days"),
        F.coalesce(F.sum(F.coalesce("session_duration", "data_duration")), F.lit(0.0)).alias("total_time"),
    )
    bucket = F.when(F.col("attempts") <= 10, "<=10").when(F.col("attempts") <= 50, "11-50").otherwise(">50")
    return out.withColumns({"exposure_bucket": bucket, "effective": F.col("attempts") > 10})


def diligent_performance(attempts: DataFrame, min_attempts: int = 10, min_activities: int = 5, min_days: int = 3) -> DataFrame:
    """AGG-15: attempts of diligent student-modules against the others."""
    flags = exposure(attempts).select("user_id", "module_code", ((F.col("attempts") >= min_attempts) & (F.col("unique_activities") >= min_activities) & (F.col("active_days") >= min_days)).alias("diligent"))
    rows = attempts.join(flags, ["user_id", "module_code"], "left")
    return rows.groupBy(F.coalesce("diligent", F.lit(False)).alias("diligent")).agg(
        F.count("*").alias("attempts"),
        F.count_distinct("user_id").alias("unique_students"),
        rate(success()).alias("success_rate"),
        F.median("data_duration").alias("median_duration"),
        rate((F.col("attempt_number") > 1).cast("int")).alias("repeat_attempt_rate"),
    )


def playlist_intensity(playlists: DataFrame) -> DataFrame:
    """AGG-16: mean distinct activities per playlist by module, from AGG-5."""
    return playlists.groupBy("module_code").agg(F.count("*").alias("playlists"), F.avg("unique_activities").alias("mean_unique_activities"))


def top_playlists(playlists: DataFrame, n: int = 25) -> DataFrame:
    """AGG-16: playlists by attempts."""
    return playlists.orderBy(F.desc("attempts"), "playlist_or_module_id", "module_code").limit(n)


def distinct_labels(rows: DataFrame, label: str, id_: str, context: str | None = None) -> DataFrame:
    """``display_label``: the label, with its context, then an id prefix, where labels collide."""
    base = F.coalesce(F.col(label), F.col(id_), F.lit("unknown"))
    rows = rows.withColumn("_base", base).withColumn("_n", F.count("*").over(Window.partitionBy("_base")))
    scoped = F.when(F.col("_n") == 1, F.col("_base"))
    if context:
        rows = rows.withColumn("_m", F.count("*").over(Window.partitionBy("_base", F.coalesce(context, F.lit("")))))
        scoped = scoped.when(F.col("_m") == 1, F.concat("_base", F.lit(" ("), F.coalesce(context, F.lit("-")), F.lit(")")))
        last = F.concat("_base", F.lit(" ("), F.coalesce(context, F.lit("-")), F.lit(" #"), F.substring(F.coalesce(id_, F.lit("-")), 1, 8), F.lit(")"))
    else:
        last = F.concat("_base", F.lit(" (#"), F.substring(F.coalesce(id_, F.lit("-")), 1, 8), F.lit(")"))
    return rows.withColumn("display_label", scoped.otherwise(last)).drop("_base", "_n", "_m")


def top_activities(usage: DataFrame, by: str = "attempts", n: int = 25) -> DataFrame:
    """AGG-20: most used activities with distinct display labels."""
    top = usage.orderBy(F.desc(by), "module_code", "activity_id").limit(n)
    return distinct_labels(top, "activity_label", "activity_id", "module_code")


def module_domain(attempts: DataFrame) -> DataFrame:
    """AGG-17: date range and first non-blank label per module."""
    label = F.when(F.trim("module_label") != "", F.col("module_label"))
    return attempts.groupBy("module_code").agg(F.min(label).alias("module_label"), F.min("date_utc").alias("min_date"), F.max("date_utc").alias("max_date"))


LEVELS = {"module": HIERARCHY[:3], "objective": HIERARCHY[:5], "activity": HIERARCHY}


def bottlenecks(daily: DataFrame, level: str = "activity", min_attempts: int = 1, n: int | None = None) -> DataFrame:
    """AGG-19: entities by difficulty, 0.7 failure + 0.3 retry before success.

    Rates are sums of rate x attempts over all attempts of the daily table, so days without
    any known outcome count as attempts but not as failures.  Entities without id drop out.
    """
    score = 0.7 * (1 - F.col("success_rate")) + 0.3 * F.col("retry_before_success_rate")
    over_all = lambda c: F.coalesce(F.sum(c * F.col("attempts")) / F.sum("attempts"), F.lit(0.0))
    out = daily.filter(F.col(f"{level}_id").isNotNull()).groupBy(*LEVELS[level]).agg(
        F.sum("attempts").alias("attempts"),
        *[over_all(F.col(c)).alias(c) for c in ("success_rate", "repeat_attempt_rate", "retry_before_success_rate")],
        over_all(1 - F.col("success_rate")).alias("failure_rate"),
        over_all(score).alias("bottleneck_score"),
    )
    out = out.filter(F.col("attempts") >= min_attempts)
    if n is not None:
        out = out.orderBy(F.desc("bottleneck_score"), F.desc("attempts"), f"{level}_id").limit(n)
    return distinct_labels(out, f"{level}_label", f"{level}_id", None if level == "module" else "module_code")


def classroom_mode_profiles(attempts: DataFrame) -> DataFrame:
    """AGG-10: per (mode, classroom), and per classroom over all modes."""
    scoped = attempts.select("classroom_id", "user_id", "activity_id", "objective_id", "module_code", "created_at", F.explode(F.array("work_mode", F.lit("all"))).alias("mode_scope"))
    return scoped.groupBy("mode_scope", "classroom_id").agg(
        F.count_distinct("user_id").alias("students"),
        F.count_distinct("activity_id").alias("activities"),
        F.count_distinct("objective_id").alias("objectives"),
        F.count_distinct("module_code").alias("modules"),
        F.count("*").alias("attempts"),
        F.min("created_at").alias("first_attempt_at"),
        F.max("created_at").alias("last_attempt_at"),
    )


SCOPES = ("zpdes", "playlist", "adaptive-test", "initial-test")


def classroom_activity_summary(attempts: DataFrame, weak: float = 0.60) -> DataFrame:
    """AGG-11: activity rates per classroom, summarised over classrooms by mode scope."""
    scope = F.explode(F.when(F.col("work_mode").isin(*SCOPES), F.array("work_mode", F.lit("all"))).otherwise(F.array(F.lit("all"))))
    per_class = attempts.filter("classroom_id is not null").select("classroom_id", "activity_label", success().alias("success"), scope.alias("mode_scope")).groupBy("mode_scope", "classroom_id", "activity_label").agg(F.count("*").alias("n"), sum0("success").alias("s"), rate(F.col("success")).alias("r"))
    below = F.count_if(F.col("r") < weak)
    return per_class.groupBy("mode_scope", "activity_label").agg(
        F.count("*").alias("classrooms"),
        F.avg("r").alias("mean_success_rate"),
        F.median("r").alias("median_success_rate"),
        below.alias("classrooms_below"),
        F.sum("n").alias("attempts"),
        F.sum("s").alias("successes"),
        (F.sum("s") / F.sum("n")).alias("pooled_success_rate"),
        (below / F.count("*")).alias("weak_share"),
    )


def min_attempts_slice(attempts: DataFrame, least: int) -> DataFrame:
    """FLT-2: attempts of students with at least ``least`` attempts in this slice."""
    if least <= 1:
        return attempts
    enough = attempts.filter("user_id is not null and trim(user_id) <> ''").groupBy("user_id").count().filter(F.col("count") >= least)
    return attempts.join(enough, "user_id", "left_semi")


def slice_attempts(attempts: DataFrame, start=None, end=None, module_code: str | None = None, objective_id: str | None = None, activity_id: str | None = None) -> DataFrame:
    """FLT-1: inclusive date range and optional equality per level."""
    out = attempts
    if start is not None:
        out = out.filter(F.col("date_utc") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date_utc") <= F.lit(end).cast("date"))
    for name, value in (("module_code", module_code), ("objective_id", objective_id), ("activity_id", activity_id)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out
