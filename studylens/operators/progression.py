"""Progression events and cohorts along the canonical activity order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.columns import outcome, rate, success, two_proportion_z, two_sided_p

GROUP = ["user_id", "module_code", "work_mode"]


def canonical_rank(catalog: DataFrame) -> DataFrame:
    """PRG-1: 0-based rank of every activity in its module, first place per activity id.

    ``catalog`` has module_code, activity_id, objective_order and activity_order.
    """
    place = catalog.groupBy("module_code", "activity_id").agg(F.min(F.struct("objective_order", "activity_order")).alias("place"))
    w = Window.partitionBy("module_code").orderBy("place.objective_order", "place.activity_order", "activity_id")
    return place.select("module_code", "activity_id", (F.row_number().over(w) - 1).alias("activity_rank"))


class _EarlierRanks:
    """How many of the attempts seen so far lie at a rank below a given one: an indexed tree of counts."""

    def __init__(self):
        self.tree: list[int] = [0] * 65

    def add(self, rank: int) -> None:
        size = len(self.tree) - 1
        while rank >= size:  # the new root holds what all ranks of the old tree hold
            self.tree += [0] * size
            self.tree[-1], size = self.tree[size], 2 * size
        i = rank + 1
        while i <= size:
            self.tree[i] += 1
            i += i & -i

    def below(self, rank: int) -> int:
        i, total = min(rank, len(self.tree) - 1), 0
        while i:
            total += self.tree[i]
            i -= i & -i
        return total


_PRIOR = ("prior_attempt_count", "prior_same_activity_attempt_count", "prior_before_activity_attempt_count")


def _first_with_prior(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole groups by rising time: the first of each exercise with what came strictly before it.

    Attempts of one instant wait until the instant ends, so none counts for another.
    Held are the counts by activity and the exercises of one group, and one instant.
    """
    group, now, waiting = None, None, []
    ranks, activities, exercises, before = _EarlierRanks(), {}, set(), 0
    for batch in batches:
        first, counts = [], ([], [], [])
        columns = [batch.column(c).to_pylist() for c in (*GROUP, "created_at", "activity_id", "activity_rank", "exercise_id")]
        for i, (user, module, mode, at, activity, rank, exercise) in enumerate(zip(*columns)):
            if (user, module, mode) != group:
                group, now, waiting = (user, module, mode), at, []
                ranks, activities, exercises, before = _EarlierRanks(), {}, set(), 0
            elif at != now:
                for done_rank, done in waiting:
                    ranks.add(done_rank)
                    activities[done] = activities.get(done, 0) + 1
                before, now, waiting = before + len(waiting), at, []
            if exercise not in exercises:
                exercises.add(exercise)
                first.append(i)
                for values, n in zip(counts, (before, activities.get(activity, 0), ranks.below(rank))):
                    values.append(n)
            waiting.append((rank, activity))
        rows = batch.take(pa.array(first, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(c, pa.int64()) for c in counts]], names=[*rows.schema.names, *_PRIOR])


def progression_events(attempts: DataFrame, ranks: DataFrame) -> DataFrame:
    """PRG-2: strictly earlier attempts at the first attempt of each exercise.

    A student's attempts in a module and mode are sorted by time once and counted in one
    pass: all earlier ones, those on the same activity, and those on activities of a
    lower rank, from an indexed tree over ranks.  One exchange, no join of attempts
    with attempts; a task holds the activities and exercises of one group.
    """
    rows = attempts.withColumn("y", outcome(F.col("data_correct"))).filter("y is not null and created_at is not null and exercise_id is not null and user_id is not null and work_mode is not null")
    rows = rows.join(ranks, ["module_code", "activity_id"]).select(*GROUP, "activity_id", F.col("activity_rank").cast("bigint").alias("activity_rank"), "exercise_id", "date_utc", "created_at", "event_id", "y")
    sorted_rows = rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "created_at", "event_id")
    schema = T.StructType([*sorted_rows.schema.fields, *[T.StructField(c, T.LongType()) for c in _PRIOR]])
    out = sorted_rows.mapInArrow(_first_with_prior, schema)
    later = F.greatest(F.lit(0), F.col("prior_attempt_count") - F.col("prior_before_activity_attempt_count") - F.col("prior_same_activity_attempt_count"))
    return out.select(
        *GROUP, "activity_id", "activity_rank", "exercise_id", "date_utc", "created_at", "event_id", F.col("y").alias("exercise_first_attempt_outcome"),
        "prior_attempt_count", "prior_before_activity_attempt_count", "prior_same_activity_attempt_count", later.alias("prior_later_activity_attempt_count"),
    )


def cohorts(events: DataFrame, threshold: int = 1) -> DataFrame:
    """PRG-3, PRG-6: cohorts before, after and in an activity, by module and mode."""
    same, lower, later = (F.col(f"prior_{c}_attempt_count") for c in ("same_activity", "before_activity", "later_activity"))
    parts = {"before": (same == 0) & (lower > 0) & (later == 0), "after": later >= threshold, "in_activity": (same > 0) & (later < threshold)}
    y = F.col("exercise_first_attempt_outcome")
    measures = []
    for name, condition in parts.items():
        measures += [
            F.count_if(condition).alias(f"{name}_event_count"),
            F.count_distinct(F.when(condition, F.col("user_id"))).alias(f"{name}_unique_students"),
            F.avg(F.when(condition, y)).alias(f"{name}_success_rate"),
            F.coalesce(F.sum(F.when(condition, F.col("prior_attempt_count"))), F.lit(0)).alias(f"{name}_previous_attempts"),
            F.coalesce(F.sum(F.when(condition, y)), F.lit(0.0)).cast("long").alias(f"{name}_success_count"),
        ]
    return events.groupBy("module_code", "work_mode", "activity_id").agg(*measures)


def mode_first_attempts(attempts: DataFrame, modes: tuple[str, ...] = ("zpdes", "playlist", "adaptive-test", "initial-test")) -> DataFrame:
    """PRG-4, JN-7: first-attempt success and count per activity, one pair of columns per mode."""
    first = attempts.filter("attempt_number = 1")
    wide = first.groupBy("module_code", "activity_id").pivot("work_mode", list(modes)).agg(rate(success()).alias("rate"), F.count(F.lit(1)).alias("count"))
    names = [(m, m.replace("-", "_")) for m in modes]
    return wide.select("module_code", "activity_id", *[F.col(f"{m}_rate").alias(f"{n}_success_rate") for m, n in names], *[F.coalesce(F.col(f"{m}_count"), F.lit(0)).alias(f"{n}_attempts") for m, n in names])


def node_metric(nodes: DataFrame, ratings: DataFrame, firsts: DataFrame, mode: str | None = None) -> DataFrame:
    """PRG-5: activity nodes get the mean item rating, or a mode's first-attempt rate; others NULL."""
    if mode is None:
        return nodes.join(ratings.select("activity_id", F.col("mean_rating").alias("metric")), "activity_id", "left")
    return nodes.join(firsts.select("activity_id", F.col(f"{mode.replace('-', '_')}_success_rate").alias("metric")), "activity_id", "left")


def overlay(daily: DataFrame) -> DataFrame:
    """PRG-8: attempt-weighted attempts, success and repeat rate of activity and objective nodes."""

    def level(id_: str, kind: str) -> DataFrame:
        n = F.sum("attempts")
        return daily.groupBy("module_code", F.col(id_).alias("node_id")).agg(
            F.lit(kind).alias("node_type"), n.alias("attempts"), (F.sum(F.col("success_rate") * F.col("attempts")) / n).alias("success_rate"), (F.sum(F.col("repeat_attempt_rate") * F.col("attempts")) / n).alias("repeat_attempt_rate")
        )

    return level("activity_id", "activity").unionByName(level("objective_id", "objective"))


def cohort_findings(table: DataFrame, min_events: int = 20, min_students: int = 5) -> DataFrame:
    """PRG-7: activities whose cohorts differ, with support, gap, impact and test."""
    n1, n0 = F.col("after_event_count"), F.col("before_event_count")
    gap = F.col("after_success_rate") - F.col("before_success_rate")
    enough = (n1 >= min_events) & (n0 >= min_events) & (F.col("after_unique_students") >= min_students) & (F.col("before_unique_students") >= min_students)
    z = two_proportion_z(F.col("after_success_count"), n1, F.col("before_success_count"), n0)
    rows = table.filter(enough).select(
        "module_code", "work_mode", "activity_id", gap.alias("gap"), (n0 * (1 - F.col("before_success_rate"))).alias("failure_impact"),
        F.when(gap >= 0.05, "recovery").when(gap <= -0.05, "after_friction").otherwise("stable").alias("finding"), z.alias("z"), two_sided_p(z).alias("p_value"),
    )
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("module_code", "work_mode").orderBy(F.desc(F.round("failure_impact", 6)), "activity_id")))
