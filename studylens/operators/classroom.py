"""Classroom replay, student profiles and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import rate, success, success_or_zero, trimmed

ALL_STUDENTS = "__all_students__"


def valid_classroom(c: Column) -> Column:
    return c.isNotNull() & ~trimmed(c).isin("", "None")


def effective_classrooms(attempts: DataFrame) -> DataFrame:
    """FLT-5: rows of valid classrooms; if there are none, all rows in one synthetic classroom."""
    ok = valid_classroom(F.col("classroom_id"))
    flag = attempts.agg(F.coalesce(F.max(ok), F.lit(False)).alias("_any"))
    rows = attempts.join(F.broadcast(flag)).filter(~F.col("_any") | ok)
    return rows.withColumn("classroom_id", F.when(F.col("_any"), F.col("classroom_id")).otherwise(F.lit(ALL_STUDENTS))).drop("_any")


def replay_frames(attempts: DataFrame, step: int = 10, max_frames: int = 40) -> DataFrame:
    """CLS-1: per classroom, frame, activity and student, what was done up to the frame.

    Ordinals of students advance together.  Frames lie max(step, ceil(longest /
    max_frames)) apart, up to the longest history; only cells with attempts are rows.
    A cell is emitted from per-attempt running values, where its ordinal range ends.
    """
    rows = effective_classrooms(attempts).filter("created_at is not null and activity_id is not null")
    w = Window.partitionBy("classroom_id", "user_id").orderBy("created_at", "exercise_id", "attempt_number", "event_id")
    rows = rows.select("classroom_id", "user_id", "activity_id", "exercise_id", "created_at", success_or_zero().alias("s"), F.row_number().over(w).alias("ordinal"))
    width = rows.groupBy("classroom_id").agg(F.max("ordinal").alias("longest")).withColumn("width", F.greatest(F.lit(step), F.ceil(F.col("longest") / max_frames)).cast("int"))
    rows = rows.join(width, "classroom_id").withColumn("frame", F.ceil(F.col("ordinal") / F.col("width")).cast("int"))
    fresh = Window.partitionBy("classroom_id", "user_id", "activity_id", "exercise_id").orderBy("ordinal")
    per = rows.withColumn("new_exercise", (F.row_number().over(fresh) == 1).cast("int")).groupBy("classroom_id", "user_id", "activity_id", "frame").agg(
        F.count("*").alias("n"), F.sum("s").alias("s"), F.sum("new_exercise").alias("e"), F.max("created_at").alias("t"), F.max("width").alias("width"), F.max("longest").alias("longest")
    )
    cell = Window.partitionBy("classroom_id", "user_id", "activity_id").orderBy("frame")
    total = per.withColumns({c: F.sum(c).over(cell) for c in ("n", "s", "e")} | {"until": F.coalesce(F.lead("frame").over(cell) - 1, F.ceil(F.col("longest") / F.col("width")).cast("int"))})
    out = total.withColumn("frame", F.explode(F.sequence("frame", "until")))
    return out.select("classroom_id", "frame", F.least(F.col("frame") * F.col("width"), F.col("longest")).alias("cutoff"), "activity_id", "user_id", F.col("n").alias("attempts"), F.col("s").alias("successes"), (F.col("s") / F.col("n")).alias("success_rate"), F.col("e").alias("unique_exercises"), F.col("t").alias("last_attempt_at"))


def axis_order(attempts: DataFrame, key: str) -> DataFrame:
    """CLS-2: students or activities of a classroom by first attempt; short, unique labels."""
    first = effective_classrooms(attempts).groupBy("classroom_id", key).agg(F.min("created_at").alias("first_seen_at"))
    text = F.when(F.length(key) > 48, F.concat(F.substring(key, 1, 47), F.lit("…"))).otherwise(F.col(key))
    out = first.withColumn("_label", text).withColumn("position", F.row_number().over(Window.partitionBy("classroom_id").orderBy("first_seen_at", key)))
    same = Window.partitionBy("classroom_id", "_label")
    k = F.row_number().over(same.orderBy("position"))
    return out.withColumn("label", F.when(k == 1, F.col("_label")).otherwise(F.concat("_label", F.lit(" ["), k.cast("string"), F.lit("]")))).drop("_label")


def near_size(profiles: DataFrame, target: int, tolerance: float = 0.10) -> DataFrame:
    """SEL-2: classrooms within floor and ceil of the target size, best first."""
    rows = profiles.filter(F.col("students").between(int(target * (1 - tolerance)), -int(-target * (1 + tolerance) // 1)))
    w = Window.partitionBy("mode_scope").orderBy(F.desc("activities"), F.desc("attempts"), F.desc("students"), "classroom_id")
    return rows.withColumn("rank", F.row_number().over(w))


def default_classroom(profiles: DataFrame) -> DataFrame:
    """SEL-3: one classroom per mode; zpdes prefers 15-20 students and 10-49 activities."""
    fits = (F.col("mode_scope") == "zpdes") & F.col("students").between(15, 20) & F.col("activities").between(10, 49)
    w = Window.partitionBy("mode_scope").orderBy(F.desc(fits.cast("int")), F.desc("students"), F.desc("attempts"), F.desc("activities"), "classroom_id")
    return profiles.filter(valid_classroom(F.col("classroom_id"))).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def classroom_findings(attempts: DataFrame) -> DataFrame:
    """CLS-3: per classroom the share of its two most active students, variation, weak activities and breadth."""
    rows = effective_classrooms(attempts)
    students = rows.groupBy("classroom_id", "user_id").agg(F.count("*").alias("n"), F.count_distinct("activity_id").alias("breadth"))
    place = F.row_number().over(Window.partitionBy("classroom_id").orderBy(F.desc("n"), "user_id"))
    students = students.withColumn("place", place)
    a = students.groupBy("classroom_id").agg((F.sum(F.when(F.col("place") <= 2, F.col("n"))) / F.sum("n")).alias("top_two_share"), (F.stddev_pop("n") / F.avg("n")).alias("attempts_cv"), F.avg("breadth").alias("mean_breadth"))
    b = rows.groupBy("classroom_id", "activity_id").agg(rate(success()).alias("r")).groupBy("classroom_id").agg(F.count_if(F.col("r") < 0.6).alias("weak_activities"), F.count("*").alias("activities"))
    return a.join(b, "classroom_id")


def selection_profiles(attempts: DataFrame, least: int = 1) -> DataFrame:
    """SEL-7: students with attempts, times, modules and eligibility."""
    return attempts.filter("user_id is not null").groupBy("user_id").agg(
        F.count("*").alias("attempts"), F.min("created_at").alias("first_attempt_at"), F.max("created_at").alias("last_attempt_at"),
        F.count_distinct("module_code").alias("unique_modules"), F.concat_ws(",", F.array_sort(F.collect_set("module_code"))).alias("modules"), (F.count("*") >= least).alias("eligible"),
    )


def near_target(profiles: DataFrame, target: int, tolerance: float = 0.1, k: int | None = None, seed: int = 0) -> DataFrame:
    """SEL-5: students within the attempt band; ``k`` of them in the order of a seeded hash."""
    rows = profiles.filter(F.col("attempts").between(int(target * (1 - tolerance)), -int(-target * (1 + tolerance) // 1)))
    return rows if k is None else rows.orderBy(F.xxhash64(F.lit(seed), "user_id"), "user_id").limit(k)


def representatives(profiles: DataFrame) -> DataFrame:
    """SEL-6: students at the 75th, 50th and 25th percentile of attempts (index ceil(n p) - 1)."""
    from ..functions.rank import rank_by_count

    ranked = rank_by_count(profiles.withColumn("_minus", -F.col("attempts")), "_minus", "user_id")
    wanted = F.array(*[F.struct(F.lit(p).alias("percentile"), F.greatest(F.lit(1), F.ceil(F.col("rank_n") * p)).alias("at")) for p in (0.75, 0.5, 0.25)])
    return ranked.withColumn("w", F.explode(wanted)).filter("rank = w.at").select("w.percentile", "user_id", "attempts")


def student_rollup(profiles: DataFrame) -> DataFrame:
    """SEL-9: one row per student; the rating of the module with most attempts, ties by code."""
    return profiles.groupBy("user_id").agg(F.sum("attempts").alias("attempts"), F.count("*").alias("modules"), F.min_by("final_rating", F.struct((-F.col("attempts")).alias("a"), "module_code")).alias("final_rating"))


def module_options(attempts: DataFrame, catalog: DataFrame) -> DataFrame:
    """SEL-8: modules of each student that the catalog has."""
    return attempts.filter("user_id is not null").join(catalog.select("module_code").distinct(), "module_code").groupBy("user_id", "module_code").agg(F.count("*").alias("attempts"))


def objective_summary(attempts: DataFrame, catalog: DataFrame) -> DataFrame:
    """STU-1: every catalog objective of a student's modules with attempts, success and coverage."""
    objectives = catalog.groupBy("module_code", "objective_id").agg(F.count_distinct("exercise_id").alias("exercises"))
    grid = module_options(attempts, catalog).select("user_id", "module_code").join(objectives, "module_code")
    first = F.col("attempt_number") == 1
    done = attempts.groupBy("user_id", "module_code", "objective_id").agg(F.count("*").alias("attempts"), F.count_distinct("exercise_id").alias("attempted"), F.count_if(first).alias("first_attempts"), rate(success()).alias("success_rate"), rate(F.when(first, success())).alias("first_attempt_success_rate"))
    out = grid.join(done, ["user_id", "module_code", "objective_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("user_id", "module_code", "objective_id", "exercises", zero("attempts"), zero("attempted"), zero("first_attempts"), "success_rate", "first_attempt_success_rate", (F.coalesce("attempted", F.lit(0)) / F.col("exercises")).alias("coverage"))


def module_totals(summary: DataFrame) -> DataFrame:
    """STU-2: coverage and mean success per student and module."""
    return summary.groupBy("user_id", "module_code").agg(F.sum("attempts").alias("attempts"), (F.sum("attempted") / F.sum("exercises")).alias("coverage"), F.avg("success_rate").alias("mean_success_rate"))


def strengths(summary: DataFrame) -> DataFrame:
    """STU-3: objectives above or below the student's own median success and coverage."""
    middle = summary.groupBy("user_id").agg(F.median("success_rate").alias("m"), F.median("coverage").alias("c"))
    kind = F.when(F.col("success_rate") > F.col("m"), "strength").when(F.col("success_rate") < F.col("m"), "gap").otherwise("typical")
    return summary.join(middle, "user_id").select("user_id", "module_code", "objective_id", (F.col("success_rate") - F.col("m")).alias("success_gap"), (F.col("coverage") - F.col("c")).alias("coverage_gap"), kind.alias("finding"))
