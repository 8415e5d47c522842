"""Steps whose state must not grow with the table."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from studylens.operators import daily, ratings
from studylens.sources import ingest

from .test_operators import attempts


def test_fits_on_bins_equal_fits_on_rows(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(1500, 160), float(rng.random() < 0.3 + 0.2 * i), float(rng.randrange(1, 3))) for i in range(2) for _ in range(6000)]
    binned = ratings._binned(spark.createDataFrame(rows, "i bigint, other double, y double, n double"), "i", "other").orderBy("i")
    lists = binned.toArrow().to_batches()[0]
    row, o = ratings._entries(lists)
    assert len(row) <= 2 * 1800 / ratings.SPAN  # rows of an item don't gather
    start = np.array([1400.0, 1700.0])
    got = ratings._newton(start, row, o["at"], o["s"], [o[f"m{k}"] for k in range(4)], -1)
    i, other, y, n = (np.array(c) for c in zip(*rows))
    assert got == pytest.approx(ratings._newton(start, i, other, n * y, [n], -1), abs=1e-7)
    found = next(ratings._golden_items(iter([lists]))).column("rating").to_numpy()
    for k in range(2):
        at = i == k
        cost = lambda r: (n[at] * np.logaddexp(0, ratings.SLOPE * (other[at] - r)) - n[at] * y[at] * ratings.SLOPE * (other[at] - r)).sum() + 0.5 * ((r - ratings.BASE) / ratings.ITER_SD) ** 2
        a, b, ratio = ratings.LOW, ratings.HIGH, (5**0.5 - 1) / 2
        for _ in range(ratings.GOLDEN_STEPS):
            c, d = b - ratio * (b - a), a + ratio * (b - a)
            a, b = (a, d) if cost(c) <= cost(d) else (c, b)
        assert found[k] == pytest.approx((a + b) / 2, abs=1e-3)


def test_replays_go_on_over_batches():
    rows = pa.RecordBatch.from_pylist([{"user_id": u, "i": i, "first": f, "y": y, "rating": 1500.0} for u, i, f, y in [("a", 1, True, 1.0), ("a", 2, True, 1.0), ("a", 1, False, 0.0), ("b", 1, True, 0.0), ("b", 2, True, 1.0)]])
    whole = pa.Table.from_batches(ratings._before_firsts(iter([rows]))).to_pylist()
    parts = pa.Table.from_batches(ratings._before_firsts(rows.slice(k, 1) for k in range(5))).to_pylist()
    assert whole == parts and [(r["i"], r["pre"]) for r in whole] == [(1, 1500.0), (2, 1512.0), (1, 1500.0), (2, 1488.0)]


def test_iterative_ratings_without_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    df = attempts(spark, [{"user_id": f"u{u}", "exercise_id": f"e{e}", "minute": 10 * e, "data_correct": rng.random() < 0.2 + 0.15 * e} for u in range(5) for e in range(4)])
    rows = ratings.replay_rows(df)
    whole = {r.exercise_id: r.rating for r in ratings.iterative_ratings(rows, 2).collect()}
    monkeypatch.setattr(ratings, "BROADCAST_ITEMS", 0)
    assert {r.exercise_id: r.rating for r in ratings.iterative_ratings(rows, 2).collect()} == pytest.approx(whole, abs=1e-6)


def test_quoted_lines_are_cut_as_by_looking_ahead(spark):
    rng = random.Random(8)
    lines = ["", ",", '"', 'a,"b,c",d', '"a","b""c,",', 'x"y,z', '"a,b', 'q\u0001,"r,s"', '1,"\u0001,",2'] + ["".join(rng.choice('a,",\u0001' if k % 5 == 0 else 'a,"') for _ in range(rng.randrange(1, 25))) for k in range(300)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for r in df.select("line", ingest._quoted_split(F.col("line")).alias("cut"), F.split("line", r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1).alias("looked")).collect():
        assert r.cut == r.looked, r.line


def test_a_line_is_cut_once(spark):
    lines = spark.createDataFrame([("a,b",)], "value string")
    plan = ingest.researcher_rows(lines, ingest.REQUIRED)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?=") == 1  # the look-ahead is the last resort, and not repeated by column


def test_playlists_are_decided_on_groups(spark):
    rows = [{"playlist_or_module_id": p, **m} for p in ("p1", "p2") for m in ({}, {"module_code": None, "module_id": None, "module_label": None}) if p == "p1" or m] + [{"playlist_or_module_id": "p1", "user_id": "u2"}]
    usage = daily.playlist_module_usage(attempts(spark, rows))
    assert {(r.playlist_or_module_id, r.module_code, r.attempts, r.unique_students) for r in usage.collect()} == {("p1", "M1", 2, 2), ("p2", None, 1, 1)}
    plan = usage._jdf.queryExecution().executedPlan().toString()
    # neither the window nor a sort meets rows that are not summed: no sorted aggregate counts distinct values
    assert "Expand" in plan and not any("SortAggregate" in line and "user_id" in line for line in plan.splitlines())
    assert plan.index("Window") < plan.index("HashAggregate")
