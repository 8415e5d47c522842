"""Sequence, window and path operators over attempts.

Every order ends in exercise and row id, so ties have one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import rate, success, sum0
from ..functions.rank import rank_by_range

ORDER = ["created_at", "exercise_id", "attempt_number", "event_id"]


def transition_edges(attempts: DataFrame) -> DataFrame:
    """WIN-1: consecutive activities of a student by date of the first; self-transitions stay.

    A next attempt without activity is no edge; the attempt after it does not move up.
    """
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    names = ["activity_id", "activity_label", "module_code", "module_id", "module_label", "objective_id"]
    rows = attempts.select("user_id", "date_utc", *names, F.lead(F.struct(*names, success().alias("success"))).over(w).alias("next")).filter("next.activity_id is not null")
    keys = [F.col(c).alias(f"from_{c}") for c in names[:5]] + [F.col(f"next.{c}").alias(f"to_{c}") for c in names[:3]]
    return rows.groupBy("date_utc", *keys).agg(
        F.count("*").alias("transition_count"),
        sum0("next.success").alias("destination_successes"),
        rate((F.col("objective_id") == F.col("next.objective_id")).cast("int")).alias("same_objective_rate"),
    )


def cross_objective_edges(edges: DataFrame, n: int = 20) -> DataFrame:
    """WIN-2: most frequent edges between objectives."""
    keys = [f"{side}_{c}" for side in ("from", "to") for c in ("activity_id", "activity_label", "module_code")]
    out = edges.filter("same_objective_rate < 1").groupBy(*keys).agg(F.sum("transition_count").alias("transition_count"))
    return out.orderBy(F.desc("transition_count"), "from_activity_id", "to_activity_id").limit(n)


def edge_share(edges: DataFrame, attempts: DataFrame) -> DataFrame:
    """WIN-3: transitions as a share of the attempts in the source activity's objective."""
    totals = edges.groupBy("from_activity_id", "to_activity_id").agg(F.sum("transition_count").alias("transition_count"))
    objective = attempts.groupBy("activity_id").agg(F.min("objective_id").alias("objective_id"))
    size = attempts.groupBy("objective_id").agg(F.count("*").alias("objective_attempts"))
    out = totals.join(objective, F.col("from_activity_id") == F.col("activity_id"), "left").join(size, "objective_id", "left")
    return out.select("from_activity_id", "to_activity_id", "transition_count", "objective_attempts", (F.col("transition_count") / F.col("objective_attempts")).alias("share"))


def work_mode_paths(attempts: DataFrame) -> DataFrame:
    """WIN-4: per student the first mode and up to three mode changes."""
    w = Window.partitionBy("user_id").orderBy("student_attempt_index", "created_at", "work_mode", "event_id")
    last = F.lag("work_mode").over(w)
    rows = attempts.filter("work_mode is not null").select("user_id", "work_mode", F.row_number().over(w).alias("at"), (last.isNull() | (last != F.col("work_mode"))).cast("int").alias("new"))
    rows = rows.withColumn("change", F.sum("new").over(Window.partitionBy("user_id").orderBy("at")) - 1).filter("new = 1")
    pick = lambda k: F.max(F.when(F.col("change") == k, F.col("work_mode")))
    return rows.groupBy("user_id").agg(
        pick(0).alias("first_work_mode"),
        *[pick(k).alias(f"transition_{k}_mode") for k in (1, 2, 3)],
        F.max("change").alias("total_transitions"),
        (F.max("change") > 3).alias("continues_after_transition_3"),
    )


def work_mode_edges(paths: DataFrame, min_count: int = 1) -> DataFrame:
    """WIN-6: edges between path stages with terminals; share of all students."""
    stages = ["first_work_mode", *[f"transition_{k}_mode" for k in (1, 2, 3)]]
    steps = []
    for k in range(4):
        if k == 3:
            target = F.when(F.col("continues_after_transition_3"), "more_than_3").otherwise("stopped_after_3")
            steps.append(F.when(F.col(stages[3]).isNotNull(), F.struct(F.lit(3).alias("stage"), F.col(stages[3]).alias("source"), target.alias("target"))))
        else:
            end = F.lit("no_transition" if k == 0 else f"stopped_after_{k}")
            steps.append(F.when(F.col(stages[k]).isNotNull(), F.struct(F.lit(k).alias("stage"), F.col(stages[k]).alias("source"), F.coalesce(F.col(stages[k + 1]), end).alias("target"))))
    edges = paths.select(F.explode(F.array_compact(F.array(*steps))).alias("e")).groupBy("e.stage", "e.source", "e.target").agg(F.count("*").alias("student_count"))
    students = paths.agg(F.count("*").alias("students"))
    out = edges.join(F.broadcast(students)).select("stage", "source", "target", "student_count", (F.col("student_count") / F.col("students")).alias("student_share"))
    return out.filter(F.col("student_count") >= min_count)


def work_mode_path_ranking(paths: DataFrame) -> DataFrame:
    """WIN-7: full displayed paths with counts and ranks."""
    path = F.concat_ws(" > ", "first_work_mode", "transition_1_mode", "transition_2_mode", "transition_3_mode", F.when(F.col("continues_after_transition_3"), F.lit("...")))
    out = paths.groupBy(path.alias("path")).agg(F.count("*").alias("student_count"))
    students = paths.agg(F.count("*").alias("students"))
    out = out.join(F.broadcast(students)).select("path", "student_count", (F.col("student_count") / F.col("students")).alias("student_share"))
    return rank_by_range(out, F.desc("student_count"), F.asc("path"))


def first_visits(attempts: DataFrame) -> DataFrame:
    """WIN-8: each student's activities in order of first visit; blanks drop out."""
    rows = attempts.filter("trim(user_id) <> '' and trim(activity_id) <> '' and created_at is not null")
    seen = rows.groupBy("user_id", "activity_id").agg(F.min(F.struct("created_at", "activity_id", "exercise_id", "attempt_number", "event_id")).alias("first"))
    w = Window.partitionBy("user_id").orderBy("first.created_at", "first.activity_id", "first.exercise_id", "first.attempt_number", "first.event_id")
    return seen.select("user_id", "activity_id", F.col("first.created_at").alias("first_seen_at"), F.row_number().over(w).alias("step"))


def first_visit_paths(attempts: DataFrame) -> DataFrame:
    """WIN-8: the ordered path of each student as text, and its length."""
    steps = F.sort_array(F.collect_list(F.struct("step", "activity_id")))
    return first_visits(attempts).groupBy("user_id").agg(F.concat_ws(">", F.transform(steps, lambda x: x["activity_id"])).alias("path"), F.count("*").alias("path_length"))


def path_stage_edges(attempts: DataFrame, start: int = 1, visible: int = 5) -> DataFrame:
    """WIN-9: edges between path steps in a window of steps, with terminals and shares."""
    visits = first_visits(attempts)
    w = Window.partitionBy("user_id").orderBy("step")
    last = start + visible - 1
    target = F.when(F.col("next").isNull(), F.concat(F.lit("stopped_after_"), F.col("step").cast("string"))).when(F.col("step") == last, F.lit(f"more_than_{last}")).otherwise(F.col("next"))
    rows = visits.withColumn("next", F.lead("activity_id").over(w)).filter(F.col("step").between(start, last))
    edges = rows.groupBy("step", F.col("activity_id").alias("source"), target.alias("target")).agg(F.count("*").alias("student_count"))
    students = visits.agg(F.count_distinct("user_id").alias("students"))
    source = F.sum("student_count").over(Window.partitionBy("step", "source"))
    return edges.join(F.broadcast(students)).select("step", "source", "target", "student_count", (F.col("student_count") / F.col("students")).alias("student_share"), (F.col("student_count") / source).alias("source_share"))


def first_exposures(attempts: DataFrame, mode: str | None = None) -> DataFrame:
    """WIN-12: earliest first attempt per student and exercise."""
    rows = attempts.filter("attempt_number = 1")
    if mode:
        rows = rows.filter(F.col("work_mode") == mode)
    w = Window.partitionBy("user_id", "exercise_id").orderBy("created_at", "event_id")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def progress_quantiles(exposures: DataFrame) -> DataFrame:
    """WIN-13: ordinal of each first exposure over their number, per student."""
    w = Window.partitionBy("user_id")
    rows = exposures.withColumn("ordinal", F.row_number().over(w.orderBy("created_at", "exercise_id", "event_id")))
    return rows.withColumn("progress_quantile", F.col("ordinal") / F.count("*").over(w))


def retry_exposures(attempts: DataFrame) -> DataFrame:
    """WIN-11: a new exposure starts at the first attempt and where the number does not rise."""
    w = Window.partitionBy("user_id", "exercise_id").orderBy("created_at", "event_id")
    last = F.lag("attempt_number").over(w)
    new = (last.isNull() | (F.col("attempt_number") <= last)).cast("int")
    return attempts.withColumn("new_exposure", new).withColumn("exposure_index", F.sum("new_exposure").over(w))


def trajectories(attempts: DataFrame, scope: str = "student", min_run: int = 1) -> DataFrame:
    """WIN-14: first retained attempt per exercise, cut into runs of one mode.

    In module scope a change of module also starts a run.
    """
    first = Window.partitionBy("user_id", "exercise_id").orderBy("created_at", "event_id")
    rows = attempts.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    w = Window.partitionBy("user_id").orderBy("created_at", "exercise_id", "event_id")
    change = ~F.lag("work_mode").over(w).eqNullSafe(F.col("work_mode"))
    if scope == "module":
        change = change | ~F.lag("module_code").over(w).eqNullSafe(F.col("module_code"))
    rows = rows.withColumn("_new", (change | (F.row_number().over(w) == 1)).cast("int")).withColumn("run", F.sum("_new").over(w))
    run = Window.partitionBy("user_id", "run")
    out = rows.withColumns({"position": F.row_number().over(run.orderBy("created_at", "exercise_id", "event_id")) - 1, "run_length": F.count("*").over(run)})
    return out.filter(F.col("run_length") >= min_run).drop("_new")


def segment_progress(runs: DataFrame) -> DataFrame:
    """MOD-4: success of the second half minus the first half of each run, times 100.

    The middle row of an odd run is in neither half.
    """
    half = F.floor(F.col("run_length") / 2)
    early = F.when(F.col("position") < half, success())
    late = F.when(F.col("position") >= F.col("run_length") - half, success())
    return runs.filter("run_length >= 2").groupBy("user_id", "run", "work_mode").agg(F.max("run_length").alias("run_length"), (100 * (F.avg(late) - F.avg(early))).alias("progress"))


def empirical_curve(runs: DataFrame, ratings: DataFrame | None = None) -> DataFrame:
    """MOD-6: success by mode and position, with item rating and its coverage."""
    from .ratings import with_rating  # ratings read paths through the audit

    if ratings is None:
        return runs.groupBy("work_mode", "position").agg(F.count("*").alias("attempts"), rate(success()).alias("success_rate"))
    mean = ratings.groupBy("exercise_id").agg(F.avg("rating").alias("_mean"))
    rows = with_rating(runs, ratings, "_exact", "left").join(mean, "exercise_id", "left").withColumn("item_rating", F.coalesce("_exact", "_mean"))
    return rows.groupBy("work_mode", "position").agg(F.count("*").alias("attempts"), rate(success()).alias("success_rate"), F.avg("item_rating").alias("mean_item_rating"), (F.count("item_rating") / F.count("*")).alias("rating_coverage"))


def _chosen(rows: DataFrame, users: list[str] | None) -> DataFrame:
    return rows if users is None else rows.filter(F.col("user_id").isin(users))


def individual_series(attempts: DataFrame, cutoff: int, users: list[str] | None = None) -> DataFrame:
    """WIN-16: attempts and success per activity of each (chosen) student up to an ordinal."""
    rows = _chosen(attempts, users).filter(F.col("student_attempt_index") <= cutoff)
    return rows.groupBy("user_id", "activity_id").agg(F.count("*").alias("attempts"), rate(success()).alias("success_rate"), F.max("student_attempt_index").alias("last_ordinal"))


def individual_findings(attempts: DataFrame, cutoff: int, mapped: DataFrame, users: list[str] | None = None) -> DataFrame:
    """STU-4: per student the attempts up to an ordinal, those on ``mapped`` activities, their success and the last moves.

    Unknown outcomes count as no success.  Moves are changes of activity among mapped
    attempts only, the latest three as text, oldest first.
    """
    known = mapped.select("activity_id").filter("activity_id is not null").distinct().withColumn("_mapped", F.lit(1))
    rows = _chosen(attempts, users).filter((F.col("student_attempt_index") <= cutoff) & F.col("user_id").isNotNull()).join(known, "activity_id", "left").withColumn("_mapped", F.coalesce("_mapped", F.lit(0)))
    per = rows.groupBy("user_id").agg(
        F.count("*").alias("visible_attempts"), F.sum("_mapped").alias("mapped_attempts"), F.count_distinct(F.when(F.col("_mapped") == 1, F.col("activity_id"))).alias("mapped_activities"),
        F.sum(F.when(F.col("_mapped") == 1, F.coalesce(success(), F.lit(0)))).alias("_s"),
    )
    moves = last_moves(rows.filter("_mapped = 1"), cutoff)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("student_attempt_index", F.concat("from_activity_id", F.lit(" -> "), "to_activity_id").alias("move")))), lambda x: x["move"]), " | ")
    out = per.join(moves.groupBy("user_id").agg(text.alias("recent_moves")), "user_id", "left")
    return out.select("user_id", "visible_attempts", "mapped_attempts", (F.col("visible_attempts") - F.col("mapped_attempts")).alias("unmapped_attempts"), "mapped_activities", F.when(F.col("mapped_attempts") > 0, F.col("_s") / F.col("mapped_attempts")).alias("mapped_success_rate"), "recent_moves")


def last_moves(attempts: DataFrame, cutoff: int, n: int = 3, users: list[str] | None = None) -> DataFrame:
    """WIN-16: the last distinct activity changes before an ordinal."""
    w = Window.partitionBy("user_id").orderBy("student_attempt_index")
    rows = _chosen(attempts, users).filter(F.col("student_attempt_index") <= cutoff).select("user_id", "student_attempt_index", "activity_id", F.lag("activity_id").over(w).alias("from_activity_id"))
    moves = rows.filter("from_activity_id is not null and from_activity_id <> activity_id")
    back = Window.partitionBy("user_id").orderBy(F.desc("student_attempt_index"))
    return moves.withColumn("recency", F.row_number().over(back)).filter(F.col("recency") <= n).select("user_id", "recency", "student_attempt_index", "from_activity_id", F.col("activity_id").alias("to_activity_id"))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)
