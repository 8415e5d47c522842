"""Student and exercise ratings on a logistic scale (1500 points, 400 per factor ten)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import outcome, real_text, two_sided_p
from ..functions.lineage import dropped, kept, stored
from .audit import distribution

# fixed values of the rating model
BASE, SCALE, K = 1500.0, 400.0, 24.0
BATCH_SD, NEWTON_STEPS, BATCH_ROUNDS, BATCH_MEDIAN, BATCH_MAX = 250.0, 16, 10, 0.5, 3.0
ITER_SD, SMOOTHING, LOW, HIGH, GOLDEN_STEPS, ITER_ROUNDS, ITER_MEDIAN, ITER_MAX = 200.0, 20.0, 600.0, 2400.0, 40, 10, 1.0, 5.0
SLOPE = math.log(10.0) / SCALE
#: An exercise is rated in its context: the same exercise elsewhere is another item.
CONTEXT = ["module_code", "objective_id", "activity_id", "exercise_id"]
#: A constant of earlier fits that folded over single rows.
FOLD_ROWS = 100_000
#: Exercises up to which their ratings are broadcast to the runs of attempts.
BROADCAST_ITEMS = 1_000_000
#: Points of a rating bin in prefix refits, and in fits of items.
BIN, SPAN = 1.0, 2.0
REPLAY_ORDER = ["created_at", "exercise_id", "attempt_number", "event_id"]


def calibration_rows(attempts: DataFrame) -> DataFrame:
    """ELO-3: first attempts with student, module, exercise and a readable outcome."""
    rows = attempts.filter("attempt_number = 1").withColumn("y", outcome(F.col("data_correct")))
    for c in ("user_id", "module_code", "exercise_id"):
        rows = rows.filter(real_text(F.col(c)).isNotNull())
    return rows.filter("y is not null").select("user_id", *CONTEXT, "y")


def item_key() -> Column:
    """ELO-1: key of an exercise in its context; missing levels are spelled out."""
    return F.concat_ws("␟", *[F.coalesce(F.col(c), F.lit("__NULL__")) for c in CONTEXT])


def item_columns(items: DataFrame) -> list[str]:
    """What identifies a row of ``items``: the whole context, or the part of it that the table has."""
    return [c for c in CONTEXT if c in items.columns]


def with_rating(rows: DataFrame, items: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """``rows`` with the rating of their item; missing levels of a context equal each other."""
    keys = item_columns(items)
    right = items.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("rating").alias(name))
    return rows.join(right, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], how).drop(*[f"_{c}" for c in keys])


def item_base(attempts: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """ELO-1: contexts of the catalog, and the observed contexts that it lacks."""
    seen = attempts.filter("exercise_id is not null").groupBy(*CONTEXT).agg(F.min(F.col("work_mode") == "initial-test").alias("_initial"), F.min("activity_label").alias("_label")).withColumn("item_key", item_key())
    if catalog is not None:
        known = catalog.select(*CONTEXT, F.col("activity_label")).withColumn("item_key", item_key()).dropDuplicates(["item_key"])
        seen = seen.join(known.select("item_key"), "item_key", "left_anti")
    unmapped = F.concat(F.lit("Unmapped initial-test activity ("), F.coalesce("module_code", F.lit("-")), F.lit(")"))
    label = F.coalesce("_label", F.when(F.col("activity_id").isNull() & F.col("_initial"), unmapped), F.col("activity_id"))
    out = seen.select(*CONTEXT, label.alias("activity_label"), F.lit(False).alias("in_catalog"), "item_key")
    if catalog is not None:
        out = out.unionByName(known.withColumn("in_catalog", F.lit(True)).select(*out.columns))
    return out


def smoothed_start(rows: DataFrame, by_module: bool = True) -> DataFrame:
    """ELO-4: smoothed success rate as a rating, item mean moved to 1500 per module (or over all)."""
    items, scope = (item_columns(rows), ["module_code"]) if by_module else (["exercise_id"], [])
    return _smoothed(rows.groupBy(*items).agg(F.count("*").alias("calibration_attempts"), F.sum("y").alias("_s")), items, scope)


def _smoothed(sums: DataFrame, items: list[str], scope: list[str]) -> DataFrame:
    """Start ratings from attempts and successes of each item."""
    whole = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))
    overall = F.sum("_s").over(whole) / F.sum("calibration_attempts").over(whole)
    smoothed = F.greatest(F.lit(0.01), F.least(F.lit(0.99), (F.col("_s") + SMOOTHING * overall) / (F.col("calibration_attempts") + SMOOTHING)))
    sums = sums.withColumn("smoothed_rate", smoothed).withColumn("_raw", BASE - SCALE * F.log10(F.col("smoothed_rate") / (1 - F.col("smoothed_rate"))))
    return sums.select(*items, "calibration_attempts", (F.col("_s") / F.col("calibration_attempts")).alias("calibration_success_rate"), "smoothed_rate", (F.col("_raw") - F.avg("_raw").over(whole) + BASE).alias("rating"))


def _binned(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with ``value``, y and n per key, summed by bin of SPAN points, as one list ``o`` per key.

    A bin keeps successes, attempts and three power sums of the distance from its centre.
    Fits expand the logistic function around the centre, which leaves out less than 1e-11
    of an attempt's term, so a key has a few hundred entries however many rows it has, and
    every task adds up its part before anything moves.
    """
    d, n = F.col(value) - F.col("at"), F.col("n")
    sums = rows.withColumn("at", (F.floor(F.col(value) / SPAN) + 0.5) * SPAN).groupBy(key, "at")
    bins = sums.agg(F.sum(n * F.col("y")).alias("s"), F.sum(n).alias("m0"), F.sum(n * d).alias("m1"), F.sum(n * d * d).alias("m2"), F.sum(n * d * d * d).alias("m3"))
    return bins.groupBy(key).agg(F.collect_list(F.struct("at", "s", "m0", "m1", "m2", "m3")).alias("o"))


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row number of each entry of the lists ``o``, and the entries' fields."""
    lists = batch.column("o")
    flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return row, {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _newton(start: np.ndarray, row: np.ndarray, at: np.ndarray, successes: np.ndarray, powers: list[np.ndarray], sign: int) -> np.ndarray:
    """Gaussian-prior Newton fits of many ratings at once; each stops after a step below 0.01.

    An entry belongs to rating ``row``, stands at ``at`` and has ``powers``: attempts, and of
    a bin the power sums too.  ``sign`` is 1 for a student against items, -1 for an item
    against students.
    """
    inverse, size, now = 1.0 / BATCH_SD**2, len(start), start.astype(float)
    done, m = np.zeros(size, dtype=bool), [x * (-sign * SLOPE) ** k for k, x in enumerate(powers)]
    for _ in range(NEWTON_STEPS):
        p = np.clip(1 / (1 + np.exp(sign * SLOPE * (at - now[row]))), 1e-9, 1 - 1e-9)
        q = p * (1 - p)
        expected, curved = m[0] * p, m[0] * q
        if len(m) > 1:
            d2, d3 = q * (1 - 2 * p), q * (1 - 6 * q)
            expected += m[1] * q + m[2] / 2 * d2 + m[3] / 6 * d3
            curved += m[1] * d2 + m[2] / 2 * d3 + m[3] / 6 * d2 * (1 - 12 * q)
        g = (now - BASE) * inverse + sign * SLOPE * np.bincount(row, weights=expected - successes, minlength=size)
        step = g / (inverse + SLOPE**2 * np.bincount(row, weights=curved, minlength=size))
        now = np.where(done, now, np.clip(now - step, LOW, HIGH))
        done |= np.abs(step) < 0.01
        if done.all():
            break
    return now


def _fit_students(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists ``o`` of (other, y, n) and ``start`` to all other columns and ``rating``."""
    for batch in batches:
        row, o = _entries(batch)
        fitted = _newton(batch.column("start").to_numpy(), row, o["other"], o["n"] * o["y"], [o["n"]], 1)
        yield batch.drop_columns(["start"]).append_column("rating", pa.array(fitted))


def _fit_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists ``o`` of bins and ``start`` to ``i`` and ``rating``."""
    for batch in batches:
        row, o = _entries(batch)
        fitted = _newton(batch.column("start").to_numpy(), row, o["at"], o["s"], [o[f"m{k}"] for k in range(4)], -1)
        yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(fitted)], names=["i", "rating"])


def joint_ratings(rows: DataFrame, rounds: int = BATCH_ROUNDS) -> DataFrame:
    """ELO-5: ratings of exercises in their context by alternating student and item fits.

    A module stops on its own round, when its item changes have a median below 0.5 and a
    maximum below 3, measured before the items are moved back to a mean of 1500.  A
    student's items of a module are one list, at most as long as the module's catalog; an
    item's students are summed by bin.  Each round is stored; one row per module returns
    to the driver.
    """
    per = kept(rows.groupBy("user_id", *CONTEXT).agg(F.sum("y").alias("_s"), F.count("*").alias("_n")).withColumn("item", item_key()))
    sums = per.groupBy(*CONTEXT).agg(F.sum("_n").alias("calibration_attempts"), F.sum("_s").alias("_s"))
    contexts = stored(_smoothed(sums, CONTEXT, ["module_code"]).withColumns({"item": item_key(), "i": F.monotonically_increasing_id()}).select("i", "item", *CONTEXT, "rating"), "elo-contexts")
    seen = per.join(contexts.select("item", "i"), "item").select("module_code", "user_id", F.struct("i", (F.col("_s") / F.col("_n")).alias("y"), F.col("_n").cast("double").alias("n")).alias("o"))
    students = seen.groupBy("module_code", "user_id").agg(F.collect_list("o").alias("o")).select("module_code", F.monotonically_increasing_id().alias("u"), "o", F.lit(BASE).alias("rating"))
    students = stored(students, "elo-students")
    items = contexts.select("module_code", "i", "rating", F.lit(0.0).alias("shift"))
    open_ = {r[0] for r in contexts.select("module_code").distinct().collect()}
    for _ in range(rounds):
        if not open_:
            break
        live = lambda df: df.filter(F.col("module_code").isin(*open_))
        now = live(items)
        pairs = live(students).select("module_code", "u", "rating", F.inline("o")).join(now.select("i", F.col("rating").alias("other"), "shift"), "i")
        listed = pairs.groupBy("module_code", "u").agg(F.collect_list(F.struct("i", "other", "y", "n")).alias("o"), F.first(F.col("rating") + F.col("shift")).alias("start"))
        fitted = stored(listed.mapInArrow(_fit_students, "module_code string, u bigint, o array<struct<i bigint, other double, y double, n double>>, rating double").withColumn("o", F.transform("o", lambda x: F.struct(x["i"].alias("i"), x["y"].alias("y"), x["n"].alias("n")))), "elo-students")
        bins = _binned(fitted.select("rating", F.inline("o")), "i", "rating")
        refit = bins.join(now.select("i", F.col("rating").alias("start")), "i").mapInArrow(_fit_items, "i bigint, rating double")
        shift = BASE - F.avg("rating").over(Window.partitionBy("module_code"))
        step = kept(refit.join(now.select("module_code", "i", F.col("rating").alias("last")), "i").withColumns({"delta": F.abs(F.col("rating") - F.col("last")), "shift": shift}))
        moved = step.groupBy("module_code").agg(F.median("delta").alias("median"), F.max("delta").alias("max"))
        rest = items.filter(~F.col("module_code").isin(*open_))
        items = stored(rest.unionByName(step.select("module_code", "i", (F.col("rating") + F.col("shift")).alias("rating"), "shift")), "elo-items")
        dropped(students)
        students = fitted
        open_ = {r["module_code"] for r in moved.collect() if not (r["median"] < BATCH_MEDIAN and r["max"] < BATCH_MAX)}
    dropped(students)
    return contexts.drop("rating").join(items.select("i", "rating"), "i").select(*CONTEXT, "rating")


def replay_rows(attempts: DataFrame) -> DataFrame:
    """ELO-9: attempts that a replay reads."""
    rows = attempts.withColumn("y", outcome(F.col("data_correct"))).filter("y is not null and created_at is not null")
    for c in ("user_id", "module_code", "exercise_id"):
        rows = rows.filter(real_text(F.col(c)).isNotNull())
    return rows.select("user_id", *CONTEXT, "created_at", "attempt_number", "event_id", "y")


_EVENTS = "event_id bigint, user_id string, module_code string, objective_id string, activity_id string, exercise_id string, created_at timestamp_ntz, y double, attempt_ordinal int, item_rating double, pre double, expected double, post double"


class _Sequential:
    """One student's rating, moved by K times the surprise of each attempt."""

    def __init__(self):
        self.rating = BASE

    def step(self, item: float, y: float) -> tuple[float, float, float]:
        pre = self.rating
        p = 1 / (1 + 10 ** ((item - pre) / SCALE))
        self.rating = pre + K * (y - p)
        return pre, p, self.rating


class _Prefix:
    """One student's rating, refitted on all attempts so far from statistics by rating bin.

    Of each bin of BIN points it holds attempts, successes and the mean item rating, so a
    state has at most (highest - lowest item rating) / BIN entries however long the
    history, and states of two runs of attempts add up.  Within a bin the expected
    success is as good as linear: a refit on the attempts themselves differs by less
    than 0.01 points (tested).  A fit starts at the last rating and mostly ends after
    one or two Newton steps.
    """

    def __init__(self):
        self.rating, self.at = BASE, {}
        self.items, self.n, self.s = np.zeros(16), np.zeros(16), np.zeros(16)

    def add(self, item: float, n: float, s: float) -> None:
        """``n`` attempts with ``s`` successes at a mean item rating."""
        i = self.at.setdefault(math.floor(item / BIN), len(self.at))
        if i == len(self.items):
            self.items, self.n, self.s = (np.append(x, np.zeros(i)) for x in (self.items, self.n, self.s))
        self.n[i] += n
        self.s[i] += s
        self.items[i] += (item - self.items[i]) * n / self.n[i]

    def merge(self, other: "_Prefix") -> None:
        for i in other.at.values():
            self.add(other.items[i], other.n[i], other.s[i])

    def refit(self) -> float:
        k, inverse, rating = len(self.at), 1.0 / BATCH_SD**2, self.rating
        items, n, s = self.items[:k], self.n[:k], self.s[:k]
        for _ in range(NEWTON_STEPS):
            p = np.clip(1 / (1 + np.exp(SLOPE * (items - rating))), 1e-9, 1 - 1e-9)
            step = ((rating - BASE) * inverse + SLOPE * (n * p - s).sum()) / (inverse + SLOPE**2 * (n * p * (1 - p)).sum())
            rating = min(HIGH, max(LOW, rating - step))
            if abs(step) < 0.01:
                break
        self.rating = rating
        return rating

    def step(self, item: float, y: float) -> tuple[float, float, float]:
        pre = self.rating
        expected = 1 / (1 + 10 ** ((item - pre) / SCALE))
        self.add(item, 1.0, y)
        return pre, expected, self.refit()


def _replay(rated: DataFrame, groups: list[str], state: type) -> DataFrame:
    """Every group's attempts in order, folded one by one.

    Groups are runs of rows inside sorted partitions, so a task holds one batch and one
    student's state, never a group.
    """
    names = [c.split()[0] for c in _EVENTS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now, ordinal = None, None, 0
        for frame in frames:
            rows = []
            for *k, item, y in zip(*[frame[g].tolist() for g in groups], frame["item_rating"].tolist(), frame["y"].tolist()):
                if k != key:
                    key, now, ordinal = k, state(), 0
                ordinal += 1
                rows.append((ordinal, *now.step(item, y)))
            done = pd.DataFrame(rows, columns=["attempt_ordinal", "pre", "expected", "post"], index=frame.index)
            yield pd.concat([frame, done.astype({"attempt_ordinal": "int32"})], axis=1)[names]

    return rated.repartition(*groups).sortWithinPartitions(*groups, *REPLAY_ORDER).mapInPandas(run, _EVENTS)


def sequential_replay(rows: DataFrame, items: DataFrame, by_module: bool = True) -> DataFrame:
    """ELO-10 and ELO-12: rating before and after every attempt of a student.

    ``items`` has ratings by context, or by exercise_id alone for the global replay.  A
    run is one student's attempts (in one module).
    """
    rated = with_rating(rows, items, "item_rating")
    groups = ["user_id", "module_code"] if by_module else ["user_id"]
    return _replay(rated, groups, _Sequential)


def final_ratings(rows: DataFrame, items: DataFrame, by_module: bool = True) -> DataFrame:
    """Attempts and final rating of the sequential replay, one row per student (and module).

    Folded over sorted runs of rows as in ``sequential_replay``; only the last state of a
    run leaves the task.
    """
    groups = ["user_id", "module_code"] if by_module else ["user_id"]
    rated = with_rating(rows, items, "item_rating").select(*groups, *[c for c in REPLAY_ORDER if c not in groups], "item_rating", "y")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now, n = None, _Sequential(), 0
        for frame in frames:
            done = []
            for *k, item, y in zip(*[frame[g].tolist() for g in groups], frame["item_rating"].tolist(), frame["y"].tolist()):
                if k != key:
                    if key is not None:
                        done.append((*key, n, now.rating))
                    key, now, n = k, _Sequential(), 0
                now.step(item, y)
                n += 1
            yield pd.DataFrame(done, columns=[*groups, "attempts", "final_rating"]).astype({"attempts": "int32", "final_rating": "float64"})
        if key is not None:
            yield pd.DataFrame([(*key, n, now.rating)], columns=[*groups, "attempts", "final_rating"]).astype({"attempts": "int32"})

    schema = ", ".join(f"{g} string" for g in groups) + ", attempts int, final_rating double"
    return rated.repartition(*groups).sortWithinPartitions(*groups, *REPLAY_ORDER).mapInPandas(run, schema)


def profiles(events: DataFrame, by_module: bool = True) -> DataFrame:
    """ELO-13: attempts, first and last time, uniques and final rating."""
    groups = ["user_id", "module_code"] if by_module else ["user_id"]
    return events.groupBy(*groups).agg(
        F.count("*").alias("attempts"),
        F.min("created_at").alias("first_attempt_at"),
        F.max("created_at").alias("last_attempt_at"),
        F.count_distinct("exercise_id").alias("unique_exercises"),
        F.count_distinct("activity_id").alias("unique_activities"),
        F.max_by("post", "attempt_ordinal").alias("final_rating"),
    )


def rating_at(events: DataFrame, ordinal: int = 50) -> DataFrame:
    """ELO-14: rating after a fixed attempt; shorter trajectories stay with NULL."""
    return events.groupBy("user_id", "module_code").agg(F.count("*").alias("attempts"), F.max(F.when(F.col("attempt_ordinal") == ordinal, F.col("post"))).alias("rating"))


def activity_ratings(base: DataFrame, items: DataFrame) -> DataFrame:
    """ELO-8: mean rating, calibrated and total exercises, and coverage per activity."""
    rows = with_rating(base, items, "rating", "left")
    return rows.groupBy("module_code", "objective_id", "activity_id").agg(F.avg("rating").alias("mean_rating"), F.count("rating").alias("calibrated_exercises"), F.count("*").alias("exercises"), (F.count("rating") / F.count("*")).alias("coverage"))


def movement(events: DataFrame) -> DataFrame:
    """ELO-17: rating movement by activity with impact, severity and volatility ranks."""
    change = F.col("post") - F.col("pre")
    out = events.groupBy("activity_id").agg(
        F.count("*").alias("event_count"),
        F.count_distinct("user_id").alias("unique_students"),
        F.avg(change).alias("mean_delta"),
        F.stddev_samp(change).alias("std_delta"),
        F.avg(F.abs(change)).alias("mean_abs_delta"),
        F.sum(F.when(change < 0, change).otherwise(0.0)).alias("total_loss"),
        F.min(change).alias("worst_delta"),
    )
    z = F.when(F.col("std_delta") > 0, F.col("mean_delta") / (F.col("std_delta") / F.sqrt("event_count")))
    one = Window.partitionBy(F.lit(0))
    return out.withColumns(
        {
            "z": z,
            "impact_rank": F.row_number().over(one.orderBy(F.round("total_loss", 6), "activity_id")),
            "severity_rank": F.row_number().over(one.orderBy(F.round("mean_delta", 6), "activity_id")),
            "volatility_rank": F.row_number().over(one.orderBy(F.desc(F.round("mean_abs_delta", 6)), "activity_id")),
        }
    )


def movement_regions(events: DataFrame) -> DataFrame:
    """ELO-17: rating movement by module and objective: events, students, mean change and points lost."""
    change = F.col("post") - F.col("pre")
    return events.groupBy("module_code", "objective_id").agg(
        F.count("*").alias("event_count"), F.count_distinct("user_id").alias("unique_students"), F.avg(change).alias("mean_delta"), F.avg(F.abs(change)).alias("mean_abs_delta"), F.coalesce(F.sum(F.when(change < 0, -change)), F.lit(0.0)).alias("total_negative_loss")
    )


#: Events from which a place takes part in movement findings.
MOVEMENT_MIN_EVENTS = 20


def movement_findings(events: DataFrame, n: int = 5) -> DataFrame:
    """ELO-17: the ``n`` leading places by points lost (impact), mean change (severity), mean absolute change (volatility), and objectives by points lost (region).

    Places have at least MOVEMENT_MIN_EVENTS events.  Impact looks at places that lost
    points and severity at those with a negative mean, unless there are none.  Ties: more
    events, then module and id.  ``p_value`` tests the mean change against zero.
    """
    change = F.col("post") - F.col("pre")
    keys = ["module_code", "objective_id", "activity_id"]
    loss = F.coalesce(F.sum(F.when(change < 0, -change)), F.lit(0.0))
    both = events.groupBy(*keys).agg(F.count("*").alias("event_count"), F.avg(change).alias("mean_delta"), F.stddev_samp(change).alias("std_delta"), F.avg(F.abs(change)).alias("mean_abs_delta"), loss.alias("total_negative_loss"))
    places = kept(both.filter(F.col("event_count") >= MOVEMENT_MIN_EVENTS))
    regions = movement_regions(events).filter(F.col("event_count") >= MOVEMENT_MIN_EVENTS).select("module_code", "objective_id", F.lit(None).cast("string").alias("activity_id"), "event_count", F.lit(None).cast("double").alias("p_value"), "total_negative_loss")
    z = F.when(F.col("std_delta") > 0, F.col("mean_delta") / (F.col("std_delta") / F.sqrt("event_count")))
    places = places.withColumn("p_value", two_sided_p(z))

    def preferred(condition: Column) -> DataFrame:
        some = places.agg(F.coalesce(F.max(condition), F.lit(False)).alias("_some"))
        return places.join(F.broadcast(some)).filter(~F.col("_some") | condition).drop("_some")

    def ranked(rows: DataFrame, kind: str, value: str, rising: bool = False) -> DataFrame:
        order = F.round(value, 6)
        w = Window.partitionBy("finding").orderBy(order.asc() if rising else order.desc(), F.desc("event_count"), "module_code", "objective_id", "activity_id")
        out = rows.withColumn("finding", F.lit(kind)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
        return out.select("finding", "rank", *keys, "event_count", F.col(value).alias("value"), "p_value")

    out = ranked(preferred(F.col("total_negative_loss") > 0), "impact", "total_negative_loss")
    out = out.unionByName(ranked(preferred(F.col("mean_delta") < 0), "severity", "mean_delta", rising=True))
    return out.unionByName(ranked(places, "volatility", "mean_abs_delta")).unionByName(ranked(regions, "region", "total_negative_loss"))


def batch_replay(rows: DataFrame, items: DataFrame) -> DataFrame:
    """ELO-11: rating refitted on the whole prefix after each attempt."""
    rated = with_rating(rows, items, "item_rating")
    return _replay(rated, ["user_id", "module_code"], _Prefix)


def block_ratings(attempts: DataFrame, items: DataFrame, mode: str = "adaptive-test", only_before_practice: bool = False) -> DataFrame:
    """ELO-15: one fit per student and module on the attempts of a test block.

    Practice is any other mode; attempts of the block before and after its first are counted.
    """
    practice = attempts.filter(F.col("work_mode") != mode).groupBy("user_id", "module_code").agg(F.min("created_at").alias("practice_at"))
    block = attempts.filter(F.col("work_mode") == mode).join(practice, ["user_id", "module_code"], "left")
    before = F.col("practice_at").isNull() | (F.col("created_at") < F.col("practice_at"))
    if only_before_practice:
        block = block.filter(before)
    rated = block.withColumn("y", outcome(F.col("data_correct"))).filter("y is not null")
    rated = with_rating(rated, items, "other")
    per_item = rated.groupBy("user_id", "module_code", "other").agg(F.count("*").cast("double").alias("n"), F.avg("y").alias("y"), F.count_if(before).alias("_b"))
    listed = per_item.groupBy("user_id", "module_code").agg(F.collect_list(F.struct("other", "y", "n")).alias("o"), F.sum("n").cast("long").alias("attempts"), F.sum("_b").alias("before_practice"), F.sum(F.col("n") * F.col("y")).alias("successes"))
    block = listed.withColumn("start", F.lit(BASE))
    schema = ", ".join(f"{c} {t}" for c, t in listed.dtypes) + ", rating double"
    return block.mapInArrow(_fit_students, schema).select("user_id", "module_code", "attempts", "before_practice", (F.col("attempts") - F.col("before_practice")).alias("after_practice"), (F.col("successes") / F.col("attempts")).alias("success_rate"), "rating")


def _before_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each student's attempts to (i, pre, y): the rating before every first attempt of the sequential replay."""
    user, now = object(), BASE
    for batch in batches:
        users, y = batch.column("user_id"), batch.column("y").to_numpy()
        if not len(users):
            continue
        starts = np.ones(len(users), dtype=bool)
        starts[0] = users[0].as_py() != user
        starts[1:] = pc.not_equal(users[1:], users[:-1]).to_numpy(zero_copy_only=False)
        user, pre = users[-1].as_py(), []
        for new, item, success in zip(starts.tolist(), batch.column("rating").to_pylist(), y.tolist()):
            if new:
                now = BASE
            pre.append(now)
            now = now + K * (success - 1 / (1 + 10 ** ((item - now) / SCALE)))
        first = batch.column("first")
        yield pa.RecordBatch.from_arrays([batch.column("i").filter(first), pa.array(pre, pa.float64()).filter(first), batch.column("y").filter(first)], names=["i", "pre", "y"])


def _golden_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per item the rating of least penalised loss, by golden-section search on its students by bin.

    With x the student's lead in natural units, an attempt costs log(1 + exp(x)) - y x; what
    of y x does not depend on the item's rating is left out, as it moves no minimum.
    """
    ratio = (math.sqrt(5) - 1) / 2
    for batch in batches:
        row, o = _entries(batch)
        size, m = len(batch.column("i")), [o[f"m{k}"] * SLOPE**k for k in range(4)]
        successes = np.bincount(row, weights=o["s"], minlength=size) * SLOPE

        def loss(r):
            u = SLOPE * (o["at"] - r[row])
            p = 1 / (1 + np.exp(-u))
            q = p * (1 - p)
            all_failed = m[0] * np.logaddexp(0, u) + m[1] * p + m[2] / 2 * q + m[3] / 6 * q * (1 - 2 * p)
            return np.bincount(row, weights=all_failed, minlength=size) + successes * (r - BASE) + 0.5 * ((r - BASE) / ITER_SD) ** 2

        a, b = np.full(size, LOW), np.full(size, HIGH)
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        fc, fd = loss(c), loss(d)
        for _ in range(GOLDEN_STEPS):
            left = fc <= fd
            a, b = np.where(left, a, c), np.where(left, d, b)
            c, d = b - ratio * (b - a), a + ratio * (b - a)
            fc, fd = loss(c), loss(d)
        yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array((a + b) / 2)], names=["i", "rating"])


def iterative_ratings(rows: DataFrame, rounds: int = ITER_ROUNDS) -> DataFrame:
    """ELO-6: global exercise ratings from replays of all students.

    Each round replays every student, takes the ratings before first attempts, refits every
    exercise on them and moves the mean to 1500; changes are measured after that.  Attempts
    are sorted once; as long as the exercises fit a broadcast, every round reads the runs
    where they lie.  Two numbers per round return to the driver.
    """
    rows = kept(rows.select("user_id", "exercise_id", *[c for c in REPLAY_ORDER if c != "exercise_id"], "y"))
    start = smoothed_start(rows.filter("attempt_number = 1"), by_module=False).select("exercise_id", "rating")
    exercises = stored(start.withColumn("i", F.monotonically_increasing_id()), "elo-exercises")
    known = rows.join(exercises.select("exercise_id", "i"), "exercise_id")
    runs = known.repartition("user_id").sortWithinPartitions("user_id", *REPLAY_ORDER)
    runs = kept(runs.select("user_id", "i", F.col("attempt_number").eqNullSafe(1).alias("first"), "y", F.monotonically_increasing_id().alias("place")))
    items, small = exercises.select("i", "rating"), exercises.count() <= BROADCAST_ITEMS
    for _ in range(rounds):
        rated = runs.join(F.broadcast(items) if small else items, "i")
        if not small:
            rated = rated.repartition("user_id").sortWithinPartitions("user_id", "place")
        before = rated.select("user_id", "i", "first", "y", "rating").mapInArrow(_before_firsts, "i bigint, pre double, y double")
        found = _binned(before.withColumn("n", F.lit(1.0)), "i", "pre").mapInArrow(_golden_items, "i bigint, rating double")
        fitted = items.select("i", F.col("rating").alias("last")).join(found, "i", "left").withColumn("rating", F.coalesce("rating", F.lit(BASE)))
        step = stored(fitted.withColumn("rating", F.col("rating") - F.avg("rating").over(Window.partitionBy(F.lit(0))) + BASE), "elo-iteration")
        items = step.select("i", "rating")
        median, most = step.agg(F.median(F.abs(F.col("rating") - F.col("last"))), F.max(F.abs(F.col("rating") - F.col("last")))).first()
        if median is None or (median < ITER_MEDIAN and most < ITER_MAX):
            break
    return exercises.select("exercise_id", "i").join(items, "i").select("exercise_id", "rating")


def compare_systems(left: DataFrame, right: DataFrame) -> DataFrame:
    """ELO-18: correlation and median absolute shift of two rating tables by item."""
    both = with_rating(left.withColumnRenamed("rating", "a"), right, "b")
    return both.agg(F.count("*").alias("exercises"), F.corr("a", "b").alias("correlation"), F.median(F.abs(F.col("a") - F.col("b"))).alias("median_abs_shift"), F.avg(F.col("b") - F.col("a")).alias("mean_shift"))


def exercise_shifts(left: DataFrame, right: DataFrame, calibration: DataFrame) -> DataFrame:
    """ELO-18: both ratings of each item, their difference, and its first attempts."""
    seen = calibration.groupBy(*CONTEXT).agg(F.count("*").alias("rating"))
    both = with_rating(with_rating(left.withColumnRenamed("rating", "current_elo"), right, "iterative_elo"), seen, "calibration_attempts")
    shift = F.col("iterative_elo") - F.col("current_elo")
    return both.select(*CONTEXT, "calibration_attempts", "current_elo", "iterative_elo", shift.alias("elo_diff"), F.abs(shift).alias("abs_elo_diff"))


def shift_summary(shifts: DataFrame) -> DataFrame:
    """ELO-18: correlation, shifts, and median shifts of the quartiles of least and most first attempts."""
    quarters = distribution(shifts, "calibration_attempts", "calibration_attempts").select(F.greatest(F.lit(1.0), "p25").alias("q25"), F.greatest(F.lit(1.0), "p25", "p75").alias("q75"))
    n, shift = F.col("calibration_attempts"), F.col("abs_elo_diff")
    spread = F.stddev_pop("current_elo") * F.stddev_pop("iterative_elo")  # corr() raises where it is 0
    return shifts.join(F.broadcast(quarters)).agg(
        F.count("*").alias("exercises"),
        F.when(spread > 0, F.covar_pop("current_elo", "iterative_elo") / spread).alias("correlation"),
        F.median(shift).alias("median_abs_shift"),
        F.avg("elo_diff").alias("mean_shift"),
        F.max("q25").alias("q25_attempts"),
        F.max("q75").alias("q75_attempts"),
        F.median(F.when(n <= F.col("q25"), shift)).alias("sparse_median_shift"),
        F.median(F.when(n >= F.col("q75"), shift)).alias("dense_median_shift"),
    )


def student_gaps(both: DataFrame) -> DataFrame:
    """ELO-18: per student and module of ``aligned`` ratings the final, mean, early and late gap.

    Early and late are the first and last third (at least one attempt).
    """
    keys, gap = ["user_id", "module_code"], F.col("right_rating") - F.col("left_rating")
    sizes = both.groupBy(*keys).agg(F.count("*").alias("attempts"))
    cut = F.greatest(F.lit(1), F.floor(F.col("attempts") / 3))
    out = both.join(sizes, keys).groupBy(*keys, "attempts").agg(
        F.max_by(gap, "attempt_ordinal").alias("final_gap"),
        F.avg(F.abs(gap)).alias("mean_abs_gap"),
        F.avg(F.when(F.col("attempt_ordinal") <= cut, F.abs(gap))).alias("early_abs_gap"),
        F.avg(F.when(F.col("attempt_ordinal") > F.col("attempts") - cut, F.abs(gap))).alias("late_abs_gap"),
    )
    return out.withColumn("gap_growth", F.col("late_abs_gap") - F.col("early_abs_gap"))


def student_sample(events: DataFrame, users: list[str] | None = None) -> DataFrame:
    """ELO-19: net change, volatility and worst drop of each (chosen) student."""
    change = F.col("post") - F.col("pre")
    rows = events if users is None else events.filter(F.col("user_id").isin(users))
    return rows.groupBy("user_id").agg(
        F.count("*").alias("attempts"),
        F.sum(change).alias("net_change"),
        F.stddev_samp(change).alias("volatility"),
        F.min(change).alias("worst_drop"),
    )


def replay_series(events: DataFrame, step: int = 10, users: list[str] | None = None) -> DataFrame:
    """ELO-16: rating of each (chosen) student after every ``step`` attempts and at the end."""
    rows = events if users is None else events.filter(F.col("user_id").isin(users))
    last = F.max("attempt_ordinal").over(Window.partitionBy("user_id", "module_code"))
    return rows.withColumn("_last", last).filter((F.col("attempt_ordinal") % step == 0) | (F.col("attempt_ordinal") == F.col("_last"))).select("user_id", "module_code", F.col("attempt_ordinal").alias("cutoff"), F.col("post").alias("rating"))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """ELO-16: two systems' ratings by student, module and ordinal; raises if ordinals differ."""
    keys = ["user_id", "module_code", "attempt_ordinal"]
    both = left.select(*keys, F.col("post").alias("left_rating")).join(right.select(*keys, F.col("post").alias("right_rating")), keys, "full")
    missing = F.col("left_rating").isNull() | F.col("right_rating").isNull()
    return both.select(*keys, F.when(missing, F.raise_error(F.lit("ordinals of the two systems differ")).cast("double")).otherwise(F.col("left_rating")).alias("left_rating"), "right_rating")
