"""Distributed algorithms against brute force: prior counts, shared students, order statistics, rings, ranks, refits, audit rules."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from studylens.functions import rank
from studylens.operators import audit, daily, graph, overlap, paths, progression, ratings

from .test_operators import attempts, one


# earlier attempts


def slow_events(rows, ranks):
    """Quadratic: each first attempt of an exercise against all attempts of its student, module and mode."""
    out = {}
    placed = [(i, r) for i, r in enumerate(rows) if r["activity_id"] in ranks]
    for i, r in placed:
        same = [(j, x) for j, x in placed if (x["user_id"], x["work_mode"]) == (r["user_id"], r["work_mode"])]
        if min((x["minute"], j) for j, x in same if x["exercise_id"] == r["exercise_id"]) != (r["minute"], i):
            continue
        earlier = [x for _, x in same if x["minute"] < r["minute"]]
        lower = sum(ranks[x["activity_id"]] < ranks[r["activity_id"]] for x in earlier)
        here = sum(x["activity_id"] == r["activity_id"] for x in earlier)
        out[i] = (len(earlier), lower, here, len(earlier) - lower - here)
    return out


@pytest.mark.parametrize("instants", [3, 40])
def test_prior_counts_equal_brute_force(spark, instants):
    rng = random.Random(instants)
    rows = [{"user_id": f"u{rng.randrange(3)}", "minute": rng.randrange(instants), "activity_id": f"a{rng.randrange(150)}", "exercise_id": f"e{rng.randrange(60)}", "work_mode": rng.choice(["zpdes", "playlist"])} for _ in range(600)]
    ranks = {f"a{i}": (i * 7) % 150 for i in range(140)}  # ten activities have no rank
    table = spark.createDataFrame([("M1", a, r) for a, r in ranks.items()], "module_code string, activity_id string, activity_rank int")
    got = {r.event_id: tuple(r[f"prior_{c}attempt_count"] for c in ("", "before_activity_", "same_activity_", "later_activity_")) for r in progression.progression_events(attempts(spark, rows), table).collect()}
    assert got == slow_events(rows, ranks)


def test_prior_counts_join_no_attempts_with_attempts(spark):
    ranks = spark.createDataFrame([("M1", "a1", 0)], "module_code string, activity_id string, activity_rank int")
    plan = progression.progression_events(attempts(spark, [{}]), ranks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan


def test_earlier_ranks():
    rng, tree, seen = random.Random(1), progression._EarlierRanks(), []
    for _ in range(2000):
        r = rng.choice([rng.randrange(10), rng.randrange(3000)])
        assert tree.below(r) == sum(x < r for x in seen)
        tree.add(r)
        seen.append(r)


# items that share entities


def test_shared_counts_equal_the_self_join(spark):
    rng = random.Random(2)
    rows = [(f"u{rng.randrange(30)}", f"m{rng.randrange(2)}", f"x{rng.randrange(40)}") for _ in range(900)] + [(None, "m0", "x1"), ("u1", None, "x1"), ("u1", "m0", None)]
    df = spark.createDataFrame(rows, "who string, scope string, item string")
    held = {}
    for who, scope, item in rows:
        if None not in (who, scope, item):
            held.setdefault((scope, who), set()).add(item)
    slow = {}
    for (scope, _), items in held.items():
        for a, b in itertools.combinations(sorted(items), 2):
            slow[scope, a, b] = slow.get((scope, a, b), 0) + 1
    for block in (256, 7, 1):
        got = {(r["scope"], r.left, r.right): r.shared for r in overlap.shared_counts(df, "who", "scope", "item", block).collect()}
        assert got == slow


def test_a_student_with_many_exercises_sends_few_rows(spark):
    many = spark.range(3000).select(F.lit("u").alias("who"), F.lit("m").alias("scope"), F.format_string("x%05d", "id").alias("item"))
    out = overlap.shared_counts(many.unionByName(many.limit(2).withColumn("who", F.lit("v"))), "who", "scope", "item")
    assert out.count() == 3000 * 2999 // 2 and out.filter("shared = 2").count() == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan  # lists meet, not items


# order statistics


@pytest.mark.parametrize("kind", ["spread", "close", "ties", "one", "wide"])
def test_order_statistics(spark, kind):
    rng = random.Random(4)
    values = {
        "spread": [rng.gauss(0, 1e6) for _ in range(3000)],
        "close": [1.0 + i * 2.0**-52 for i in rng.sample(range(5000), 2000)],
        "ties": [float(rng.randrange(5)) for _ in range(2000)],
        "one": [7.25],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(500)] + [0.0, 5e-324],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = set(rng.sample(range(len(values)), min(11, len(values)))) | {0, len(values) - 1}
    assert rank.order_statistics(df, "v", ranks, buckets=16) == {r: sorted(values)[r] for r in ranks}
    weighted = df.groupBy("v").count()
    assert rank.order_statistics(weighted, "v", ranks, weight="count") == {r: sorted(values)[r] for r in ranks}


def test_distribution_sorts_nothing_in_one_task(spark):
    df = spark.createDataFrame([(random.Random(i).random(),) for i in range(50)], "v double")
    r = audit.distribution(df, "v", "x")
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    values = sorted(x.v for x in df.collect())
    assert [one(r)[f"p{round(p * 100)}"] for p in audit.PERCENTS] == [values[round(p * 49)] for p in audit.PERCENTS]
    assert audit.distribution(df.filter("v > 2"), "v", "x").count() == 0


# rings


def has_ring(edges):
    left = set(edges)
    while True:
        targets = {b for _, b in left}
        keep = {(a, b) for a, b in left if a in targets}
        if keep == left:
            return bool(left)
        left = keep


def test_rings_equal_peeling(spark):
    rng, rows, slow = random.Random(5), [], set()
    for g in range(60):
        n = rng.randrange(2, 9)
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 10))}
        if g % 2:  # only upwards: no ring
            edges = {(min(e), max(e)) for e in edges if e[0] != e[1]}
        rows += [(f"g{g}", f"{g}.{a}", f"{g}.{b}") for a, b in edges]
        slow |= {f"g{g}"} if has_ring(edges) else set()
    rows += [("odd", f"o{i}", f"o{(i + 1) % 7}") for i in range(7)] + [("tail", "t0", "t1"), ("tail", "t1", "t2"), ("tail", "t2", "t1"), ("tail", "t2", "t3")]
    df = spark.createDataFrame(rows, "g string, source string, target string")
    assert {r.g for r in graph.cyclic_groups(df, "g").collect()} == slow | {"odd", "tail"}
    assert graph.cyclic_groups(df.limit(0), "g").count() == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "kept", lambda df, real=graph.kept: rounds.append(1) or real(df))
    chain = spark.range(10_000).select(F.lit("chain").alias("g"), F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    ring = spark.range(999).select(F.lit("ring").alias("g"), F.concat(F.lit("r"), "id").alias("source"), F.concat(F.lit("r"), (F.col("id") + 1) % 999).alias("target"))
    assert [r.g for r in graph.cyclic_groups(chain.unionByName(ring), "g").collect()] == ["ring"]
    assert len(rounds) < 20


# ranks


def test_equal_counts_rank_over_several_tasks(spark):
    rng = random.Random(6)
    rows = [(f"s{i:05d}", 1, f"g{i % 2}") for i in range(4000)] + [(f"t{i}", rng.randrange(2, 5), f"g{i % 2}") for i in range(50)]
    df = spark.createDataFrame(rows, "id string, n int, g string").repartition(4)
    whole = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r.id for r in rank.rank_by_count(df, "n", "id").orderBy("rank").collect()] == [r[0] for r in whole]
    within = rank.rank_by_count(df, "n", "id", within=["g"]).collect()
    for g in ("g0", "g1"):
        assert [r.id for r in sorted((r for r in within if r.g == g), key=lambda r: r.rank)] == [r[0] for r in whole if r[2] == g]
        assert {r.rank_n for r in within if r.g == g} == {sum(r[2] == g for r in rows)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one partition
    try:
        dealt = df.repartitionByRange(F.desc("n"), "id").withColumn("p", F.spark_partition_id()).filter("n = 1").groupBy("p").count().count()
        assert dealt == 4
        assert [r.id for r in rank.rank_by_count(df, "n", "id").orderBy("rank").collect()] == [r[0] for r in whole]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# prefix refits


def full_refit(seen, start):
    r, inverse = start, 1 / ratings.BATCH_SD**2
    for _ in range(ratings.NEWTON_STEPS):
        p = [min(1 - 1e-9, max(1e-9, 1 / (1 + math.exp(ratings.SLOPE * (item - r))))) for item, _ in seen]
        g = (r - ratings.BASE) * inverse + ratings.SLOPE * sum(q - y for q, (_, y) in zip(p, seen))
        step = g / (inverse + ratings.SLOPE**2 * sum(q * (1 - q) for q in p))
        r = min(ratings.HIGH, max(ratings.LOW, r - step))
        if abs(step) < 0.01:
            break
    return r


def test_prefix_refits_stay_near_the_full_refit():
    rng, state, seen, exact, worst = random.Random(7), ratings._Prefix(), [], ratings.BASE, 0.0
    for _ in range(1200):
        item, y = rng.gauss(1500, 180), float(rng.random() < 0.6)
        seen.append((item, y))
        _, _, post = state.step(item, y)
        exact = full_refit(seen, exact)
        worst = max(worst, abs(post - exact))
    assert worst < 0.01 and len(state.at) <= 1800 / ratings.BIN


def test_prefix_statistics_merge():
    rng = random.Random(8)
    rows = [(rng.gauss(1500, 150), float(rng.random() < 0.4)) for _ in range(300)]
    whole, parts = ratings._Prefix(), [ratings._Prefix(), ratings._Prefix()]
    for i, (item, y) in enumerate(rows):
        whole.add(item, 1.0, y)
        parts[i % 2].add(item, 1.0, y)
    parts[0].merge(parts[1])
    assert parts[0].refit() == pytest.approx(whole.refit(), abs=1e-6)


# audit rules


def history(spark, outcomes, **fixed):
    rows = [{"user_id": "u1", "exercise_id": f"e{i}", "minute": i, "data_correct": y, **fixed} for i, y in enumerate(outcomes)]
    w = F.row_number().over(__import__("pyspark").sql.Window.partitionBy("user_id").orderBy("created_at", "event_id"))
    return attempts(spark, rows).withColumn("student_attempt_index", w)


def test_a_fifth_is_rounded_up(spark):
    r = one(audit.early_late(history(spark, [True, False, False, False, True, True])))
    assert (r.exposures, r.early, r.late, r.delta) == (6, 0.5, 1.0, 0.5)
    r = one(audit.early_late(history(spark, [True])))
    assert (r.early, r.late, r.delta) == (1.0, 1.0, 0.0)
    s = one(audit.early_late_summary(audit.early_late(history(spark, [False, True])), "all"))
    assert (s.scope, s.students, s.mean, s.p50, s.median_delta, s.share_improved) == ("all", 1, 1.0, 1.0, 1.0, 1.0)


def test_first_exposures_have_their_own_ordinals(spark):
    rows = history(spark, [True, False, True, True]).withColumn("exercise_id", F.when(F.col("event_id") % 2 == 0, "e0").otherwise(F.col("exercise_id")))
    firsts = audit.first_exposure_ordinals(paths.first_exposures(rows))
    assert sorted((r.event_id, r.first_exposure_index) for r in firsts.collect()) == [(0, 1), (1, 2), (3, 3)]


def test_retries_by_exposure(spark):
    plan = [("e1", 1, False), ("e1", 2, True), ("e1", 1, True), ("e2", 1, True), ("e2", 2, False), ("e3", 1, False)]
    df = attempts(spark, [{"exercise_id": e, "attempt_number": n, "data_correct": y, "minute": i} for i, (e, n, y) in enumerate(plan)])
    r = one(audit.retry_summary(df))
    assert (r.pairs, r.first_failures, r.retry_share_after_failure) == (3, 2, 0.5)
    assert (r.first_attempt_success, r.second_attempt_success, r.reused_pair_share) == (0.5, 0.5, pytest.approx(1 / 3))
    assert one(audit.retry_distribution(df)).n == 3 and one(audit.retry_distribution(df)).max == 1.0


def verdict_of(spark, users, exercises, outcome, mode="zpdes", link=lambda u, e: True):
    rows = [{"user_id": f"u{u}", "exercise_id": f"e{e}", "minute": e, "data_correct": outcome(u, e), "work_mode": mode} for u in range(users) for e in range(exercises) if link(u, e)]
    w = F.row_number().over(__import__("pyspark").sql.Window.partitionBy("user_id").orderBy("created_at", "event_id"))
    return one(audit.verdict(attempts(spark, rows).withColumn("student_attempt_index", w)))


def test_verdicts_in_order(spark):
    assert verdict_of(spark, 6, 4, lambda u, e: True, link=lambda u, e: u % 2 == e % 2).verdict == "disconnected"
    r = verdict_of(spark, 6, 4, lambda u, e: True)
    assert (r.verdict, r.sparse_share, r.exercise_share) == ("sparse", 1.0, 1.0)
    assert verdict_of(spark, 24, 5, lambda u, e: e < 4).verdict == "dynamic"  # late success falls
    assert verdict_of(spark, 24, 5, lambda u, e: True).verdict == "compressed"
    r = verdict_of(spark, 24, 6, lambda u, e: e in (0, 1, 4, 5))
    assert (r.verdict, r.mean_delta) == ("feasible", 0.0) and r.exercise_sd > 0.4


def test_component_shares_count_exercises_and_students_apart(spark):
    pairs = [("u1", "e1"), ("u1", "e2"), ("u2", "e2"), ("u3", "e3"), ("u4", "e3"), ("u5", "e3"), ("u6", "e4")]
    r = one(audit.component_shares(attempts(spark, [{"user_id": u, "exercise_id": e} for u, e in pairs])))
    # two components of four nodes: the one with more exercises is the largest
    assert (r.components, r.exercise_share, r.student_share) == (3, 0.5, pytest.approx(2 / 6))


def test_objective_days_know_repeats(spark):
    r = one(daily.objective_daily(attempts(spark, [{}, {"attempt_number": 2}, {"attempt_number": None}])))
    assert r.repeat_attempt_rate == 0.5


# iterative ratings


def golden(observed):
    """Rating of least penalised loss by golden-section search, from (student rating, outcome)."""

    def loss(r):
        total = 0.5 * ((r - ratings.BASE) / ratings.ITER_SD) ** 2
        for pre, y in observed:
            p = min(1 - 1e-9, max(1e-9, 1 / (1 + 10 ** ((r - pre) / ratings.SCALE))))
            total -= y * math.log(p) + (1 - y) * math.log(1 - p)
        return total

    a, b, k = ratings.LOW, ratings.HIGH, (math.sqrt(5) - 1) / 2
    for _ in range(ratings.GOLDEN_STEPS):
        c, d = b - k * (b - a), a + k * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return (a + b) / 2


def plain_iterative(seen, items, rounds):
    """``seen``: (student, exercise, attempt number, outcome) in order of time."""
    for _ in range(rounds):
        students, before = {}, {}
        for u, e, n, y in seen:
            pre = students.get(u, ratings.BASE)
            if n == 1:
                before.setdefault(e, []).append((pre, y))
            students[u] = pre + ratings.K * (y - 1 / (1 + 10 ** ((items[e] - pre) / ratings.SCALE)))
        new = {e: golden(before[e]) if e in before else ratings.BASE for e in items}
        shift = ratings.BASE - sum(new.values()) / len(new)
        new = {e: r + shift for e, r in new.items()}
        moved = sorted(abs(new[e] - items[e]) for e in items)
        items = new
        middle = (moved[(len(moved) - 1) // 2] + moved[len(moved) // 2]) / 2
        if middle < ratings.ITER_MEDIAN and moved[-1] < ratings.ITER_MAX:
            break
    return items


@pytest.mark.parametrize("rounds", [1, 10])
def test_iterative_ratings_equal_plain_python(spark, rounds):
    rng, rows = random.Random(9), []
    for u in range(6):
        for m, e in enumerate(rng.sample(range(5), 4)):
            for n in range(1, rng.randrange(2, 4)):
                rows.append({"user_id": f"u{u}", "exercise_id": f"e{e}", "minute": 100 * u + 10 * m + n, "attempt_number": n, "data_correct": rng.random() < 0.35 + 0.12 * e})
    df = ratings.replay_rows(attempts(spark, rows))
    start = {r.exercise_id: r.rating for r in ratings.smoothed_start(df.filter("attempt_number = 1").select("event_id", "exercise_id", "y"), by_module=False).collect()}
    seen = [(r["user_id"], r["exercise_id"], r["attempt_number"], float(r["data_correct"])) for r in sorted(rows, key=lambda r: r["minute"])]
    got = {r.exercise_id: r.rating for r in ratings.iterative_ratings(df, rounds).collect()}
    assert got == pytest.approx(plain_iterative(seen, start, rounds), abs=1e-3)
