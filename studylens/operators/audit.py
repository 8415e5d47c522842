"""Measurement-feasibility audit of attempts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import rate, real_text, success
from ..functions.lineage import kept
from ..functions.rank import order_statistics
from . import graph, overlap
from .paths import first_exposures, retry_exposures

#: Deciles, and the quartiles that ``shift_summary`` reads.
PERCENTS = (0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9)


def distribution(rows: DataFrame, value: str, name: str) -> DataFrame:
    """IRT-1: count, mean, sd, min, nearest-rank percentiles (index round(p (n - 1)), half to even) and max.

    Percentiles are order statistics found by range refinement: nothing is sorted or
    gathered, whatever the number of distinct values.  No known value, no row.
    """
    known = kept(rows.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")))
    whole = known.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max")).filter("n > 0")
    n = known.count()
    ranks = {p: round(p * (n - 1)) for p in PERCENTS}
    return _with_percentiles(whole, order_statistics(known, "v", set(ranks.values())) if n else {}, ranks, name)


def _with_percentiles(whole: DataFrame, found: dict[int, float], ranks: dict[float, int], name: str) -> DataFrame:
    cut = [F.lit(found.get(r)).cast("double").alias(f"p{round(p * 100)}") for p, r in ranks.items()]
    return whole.select("n", "mean", "sd", "min", "max", *cut, F.lit(name).alias("measure"))


def histogram_distribution(histogram: DataFrame, value: str, count: str, name: str) -> DataFrame:
    """IRT-1 over a histogram (one row per value): population sd, percentiles of rank ceil(p n), at least 1."""
    rows = kept(histogram.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.col(count).alias("k")))
    whole = rows.agg(F.sum("k").alias("n"), (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")).filter("n > 0")
    spread = rows.join(F.broadcast(whole.select("n", "mean"))).agg(F.sqrt(F.sum((F.col("v") - F.col("mean")) ** 2 * F.col("k")) / F.max("n")).alias("sd"))
    n = rows.agg(F.sum("k")).first()[0] or 0
    ranks = {p: max(1, math.ceil(p * n)) - 1 for p in PERCENTS}
    return _with_percentiles(whole.join(F.broadcast(spread)), order_statistics(rows, "v", set(ranks.values()), weight="k") if n else {}, ranks, name)


def answered(attempts: DataFrame) -> DataFrame:
    """What the audit reads: attempts with student, exercise, time, outcome and both ordinals."""
    rows = attempts.filter(real_text(F.col("user_id")).isNotNull() & real_text(F.col("exercise_id")).isNotNull())
    return rows.filter("created_at is not null and data_correct is not null and attempt_number is not null and student_attempt_index is not null")


def sparsity(attempts: DataFrame) -> DataFrame:
    """IRT-2: scale of the table, first exposures and exercises with few of them."""
    first = first_exposures(attempts)
    per_exercise = attempts.groupBy("exercise_id").agg(F.count("*").alias("attempts")).join(first.groupBy("exercise_id").agg(F.count("*").alias("first"), rate(success()).alias("r")), "exercise_id", "full")
    a = attempts.agg(F.count("*").alias("attempts"), F.count_distinct("user_id").alias("students"), F.count_distinct("exercise_id").alias("exercises"))
    b = per_exercise.agg(F.sum(F.coalesce("first", F.lit(0))).alias("first_exposures"), F.avg("attempts").alias("mean_attempts_per_exercise"), F.avg("r").alias("mean_first_success"), F.count_if(F.coalesce("first", F.lit(0)) < 20).alias("exercises_below_20"))
    out = a.join(F.broadcast(b))
    return out.withColumn("density", F.col("first_exposures") / (F.col("students") * F.col("exercises")))


def coverage(attempts: DataFrame, catalog: DataFrame) -> DataFrame:
    """IRT-3: share of the catalog a student has entered, whole and within entered modules."""
    seen = attempts.select("user_id", "module_code", "exercise_id").distinct()
    total = catalog.agg(F.count_distinct("exercise_id").alias("total"))
    modules = catalog.groupBy("module_code").agg(F.count_distinct("exercise_id").alias("size"))
    entered = seen.select("user_id", "module_code").distinct().join(modules, "module_code").groupBy("user_id").agg(F.sum("size").alias("entered"))
    per = seen.groupBy("user_id").agg(F.count_distinct("exercise_id").alias("exercises")).join(entered, "user_id").join(F.broadcast(total))
    return per.select("user_id", "exercises", (F.col("exercises") / F.col("total")).alias("catalog_share"), (F.col("exercises") / F.col("entered")).alias("entered_share"))


def exercise_pairs(attempts: DataFrame) -> DataFrame:
    """JN-9, IRT-5: exercises of a module that share students, with how many."""
    return overlap.shared_counts(attempts, "user_id", "module_code", "exercise_id").select(
        "module_code", F.col("left").alias("left_exercise_id"), F.col("right").alias("right_exercise_id"), F.col("shared").alias("shared_students")
    )


def overlap_distribution(pairs: DataFrame) -> DataFrame:
    """IRT-5: how many pairs share how many students."""
    return pairs.groupBy("shared_students").agg(F.count("*").alias("pairs"))


def projected_components(pairs: DataFrame, least: int) -> DataFrame:
    """IRT-5: components of exercises linked by at least ``least`` shared students."""
    return graph.components(pairs.filter(F.col("shared_students") >= least).select(F.col("left_exercise_id").alias("a"), F.col("right_exercise_id").alias("b")))


def tail_exercises(pairs: DataFrame, quantiles: DataFrame) -> DataFrame:
    """IRT-7 in part, as its SQL has it: exercises of low degree or only seen late; see ``module_tails``."""
    both = pairs.select("module_code", F.col("left_exercise_id").alias("exercise_id"), "shared_students").unionByName(pairs.select("module_code", F.col("right_exercise_id").alias("exercise_id"), "shared_students"))
    degree = both.groupBy("exercise_id").agg(F.count("*").alias("degree"), F.min("shared_students").alias("min_overlap"), F.median("shared_students").alias("median_overlap"), F.max("shared_students").alias("max_overlap"))
    late = quantiles.groupBy("exercise_id").agg(F.expr("percentile(progress_quantile, 0.1)").alias("p10_progress"))
    cut = degree.groupBy("degree").count().withColumn("upto", F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("degree"))).withColumn("n", F.sum("count").over(Window.partitionBy(F.lit(0))))
    cut = cut.agg(F.min(F.when(F.col("upto") > F.bround(0.1 * (F.col("n") - 1)), F.col("degree"))).alias("low_degree"))
    out = degree.join(late, "exercise_id", "left").join(F.broadcast(cut))
    return out.filter((F.col("degree") <= F.col("low_degree")) | (F.col("p10_progress") >= 0.9)).drop("low_degree")


def module_tails(exposures: DataFrame) -> DataFrame:
    """IRT-7 whole: tail exercises per module among all exercises with a first exposure.

    ``exposures`` has module_code, user_id, exercise_id and progress_quantile.  A tail has a
    degree up to the nearest-rank p10 of its module, lies in a component smaller than the
    largest of its module, or is only seen late.  Exercises that share no student with
    another have degree 0 and a component of one.
    """
    keys = ["module_code", "exercise_id"]
    rows = kept(exposures.filter("module_code is not null and exercise_id is not null").select("user_id", *keys, "progress_quantile"))
    pairs = kept(exercise_pairs(rows))
    both = pairs.select("module_code", F.col("left_exercise_id").alias("exercise_id"), "shared_students").unionByName(pairs.select("module_code", F.col("right_exercise_id").alias("exercise_id"), "shared_students"))
    degree = both.groupBy(*keys).agg(F.count("*").alias("degree"), F.min("shared_students").alias("min_overlap"), F.median("shared_students").alias("median_overlap"), F.max("shared_students").alias("max_overlap"))
    seen = rows.groupBy(*keys).agg(F.count_distinct("user_id").alias("first_attempt_students"), F.expr("percentile(progress_quantile, 0.1)").alias("p10_progress"))
    node = lambda c: F.to_json(F.array("module_code", c))
    parts = graph.components(pairs.select(node("left_exercise_id").alias("a"), node("right_exercise_id").alias("b")))
    full = seen.join(degree, keys, "left").fillna(0, ["degree", "min_overlap", "median_overlap", "max_overlap"]).withColumn("node", node("exercise_id"))
    full = kept(full.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")))
    sizes = full.groupBy("module_code", "component").agg(F.count("*").alias("component_exercises"))
    largest = sizes.groupBy("module_code").agg(F.max("component_exercises").alias("largest"))
    module = Window.partitionBy("module_code")
    steps = full.groupBy("module_code", "degree").count().withColumn("upto", F.sum("count").over(module.orderBy("degree"))).withColumn("n", F.sum("count").over(module))
    low = steps.groupBy("module_code").agg(F.min(F.when(F.col("upto") > F.bround(0.1 * (F.col("n") - 1)), F.col("degree"))).alias("low_degree"))
    out = full.join(sizes, ["module_code", "component"]).join(low.join(largest, "module_code"), "module_code")
    tail = (F.col("degree") <= F.col("low_degree")) | (F.col("component_exercises") < F.col("largest")) | (F.col("p10_progress") >= 0.9)
    return out.filter(tail).select(*keys, "first_attempt_students", "degree", "min_overlap", "median_overlap", "max_overlap", "component_exercises", "p10_progress")


def success_band(exposures: DataFrame, key: str, low: float = 0.65, high: float = 0.85) -> DataFrame:
    """IRT-8: share of exercises or students whose success over ``exposures`` lies in a band.

    The audit reads first exposures in the adaptive mode only; the caller chooses them.
    """
    rates = exposures.groupBy(key).agg(rate(success()).alias("r"))
    inside = F.col("r").between(low, high)
    return rates.agg(F.count("*").alias("entities"), F.avg("r").alias("mean_rate"), F.stddev_samp("r").alias("sd_rate"), F.avg(inside.cast("double")).alias("share_in_band"))


def early_late(rows: DataFrame, ordinal: str = "student_attempt_index") -> DataFrame:
    """IRT-9: success at the first and last fifth of a student's ordinals, a fifth being rounded up.

    The fifth is of the rows at hand, while the ordinals are those of the whole history,
    so a student whose late rows lack an outcome may have no early or late success.
    """
    total = rows.groupBy("user_id").agg(F.count("*").alias("exposures"))
    part = F.greatest(F.lit(1), F.ceil(F.col("exposures") * F.lit(0.2)))
    i, s = F.col(ordinal), success().cast("double")
    per = rows.join(total, "user_id").groupBy("user_id").agg(F.max("exposures").alias("exposures"), F.avg(F.when(i <= part, s)).alias("early"), F.avg(F.when(i > F.col("exposures") - part, s)).alias("late"))
    return per.withColumn("delta", F.col("late") - F.col("early"))


def first_exposure_ordinals(exposures: DataFrame) -> DataFrame:
    """IRT-9 over first exposures: their ordinal among the student's first exposures."""
    order = Window.partitionBy("user_id").orderBy("student_attempt_index", "exercise_id")
    return exposures.withColumn("first_exposure_index", F.row_number().over(order))


def early_late_summary(deltas: DataFrame, scope: str) -> DataFrame:
    """IRT-9: mean, median and spread of the change, and the share of students who improved."""
    whole = deltas.agg(F.count("*").alias("students"), F.median("delta").alias("median_delta"), (F.count_if(F.col("delta") > 0) / F.greatest(F.count("*"), F.lit(1))).alias("share_improved"))
    return distribution(deltas, "delta", scope).join(F.broadcast(whole)).withColumnRenamed("measure", "scope")


def growth(attempts: DataFrame) -> DataFrame:
    """IRT-10: attempts, exercises and elapsed whole days per student."""
    return attempts.groupBy("user_id").agg(F.count("*").alias("attempts"), F.count_distinct("exercise_id").alias("exercises"), F.floor(F.timestamp_diff("SECOND", F.min("created_at"), F.max("created_at")) / 86400).alias("elapsed_days"))


def exposure_retries(attempts: DataFrame) -> DataFrame:
    """IRT-11: every exposure of a student to an exercise: its first outcome and how often it was retried."""
    first = F.min_by(success(), F.struct("created_at", "attempt_number", "event_id")).alias("first")
    return retry_exposures(attempts).groupBy("user_id", "exercise_id", "exposure_index").agg(first, (F.max("attempt_number") - 1).alias("retries"))


def retry_summary(attempts: DataFrame) -> DataFrame:
    """IRT-11, RNK-5: retries of failed first exposures, success by kind of attempt, exercises met again.

    ``retry_share_after_failure`` looks at a pair's first exposure, ``first_attempt_success``
    at the start of every exposure, ``second_attempt_success`` at all second attempts
    whatever came before, ``reused_pair_share`` at pairs with more than one exposure.
    """
    per = exposure_retries(attempts)
    failed = (F.col("exposure_index") == 1) & (F.col("first") == 0)
    pairs = F.count_if(F.col("exposure_index") == 1)
    out = per.agg(
        pairs.alias("pairs"),
        F.count_if(failed).alias("first_failures"),
        (F.count_if(failed & (F.col("retries") > 0)) / F.greatest(F.count_if(failed), F.lit(1))).alias("retry_share_after_failure"),
        F.avg("first").alias("first_attempt_success"),
        (F.count_if(F.col("exposure_index") == 2) / F.greatest(pairs, F.lit(1))).alias("reused_pair_share"),
    )
    return out.join(F.broadcast(attempts.agg(F.avg(F.when(F.col("attempt_number") == 2, success())).alias("second_attempt_success"))))


def retry_distribution(attempts: DataFrame) -> DataFrame:
    """IRT-11: how often first exposures are retried."""
    return distribution(exposure_retries(attempts).filter("exposure_index = 1"), "retries", "first_exposure_retries")


def metadata_audit(exercises: DataFrame, attempts: DataFrame) -> DataFrame:
    """IRT-12: catalog exercises by type, and attempted exercises outside the catalog."""
    types = exercises.groupBy(F.coalesce("exercise_type", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("exercises"))
    missing = attempts.select("exercise_id").distinct().join(exercises.select("exercise_id"), "exercise_id", "left_anti").agg(F.lit("unmapped").alias("kind"), F.count("*").alias("exercises"))
    return types.unionByName(missing)


def component_shares(exposures: DataFrame) -> DataFrame:
    """IRT-4: exercises and students in the largest component of the student-exercise graph, and their shares.

    Largest is the one with most nodes, then most exercises.
    """
    edges = exposures.select(F.concat(F.lit("s:"), "user_id").alias("a"), F.concat(F.lit("e:"), "exercise_id").alias("b"))
    item = F.col("node").startswith("e:")
    sizes = graph.components(edges).groupBy("component").agg(F.count_if(item).alias("exercises"), F.count_if(~item).alias("students"))
    most = F.max_by(F.struct("exercises", "students"), F.struct(F.col("exercises") + F.col("students"), "exercises"))
    out = sizes.agg(F.count("*").alias("components"), most.alias("most"), F.sum("exercises").alias("e"), F.sum("students").alias("s"))
    return out.select("components", F.coalesce(F.col("most.exercises") / F.col("e"), F.lit(0.0)).alias("exercise_share"), F.coalesce(F.col("most.students") / F.col("s"), F.lit(0.0)).alias("student_share"))


def verdict(attempts: DataFrame, mode: str = "zpdes") -> DataFrame:
    """IRT-13: whether one scale for all exercises can be estimated, and what stands against it.

    In this order: the largest component holds less than 0.9 of the exercises
    (``disconnected``), more than 0.35 of them have under 20 first exposures
    (``sparse``), success changes by more than 0.05 within histories (``dynamic``),
    exercise success varies by less than 0.05 (``compressed``); else ``feasible``.
    """
    rows = answered(attempts)
    adaptive = first_exposures(rows, mode)
    scale = sparsity(rows).select((F.col("exercises_below_20") / F.greatest("exercises", F.lit(1))).alias("sparse_share"))
    growth_ = early_late(rows).agg(F.avg("delta").alias("mean_delta"))
    band = success_band(adaptive, "exercise_id").select(F.col("sd_rate").alias("exercise_sd"))
    parts = component_shares(adaptive).select("exercise_share")
    out = parts.join(F.broadcast(scale)).join(F.broadcast(growth_)).join(F.broadcast(band))
    steps = F.when(F.col("exercise_share") < 0.9, "disconnected").when(F.col("sparse_share") > 0.35, "sparse").when(F.abs("mean_delta") > 0.05, "dynamic").when(F.col("exercise_sd") < 0.05, "compressed").otherwise("feasible")
    return out.withColumn("verdict", steps)
