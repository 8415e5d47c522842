"""Literal fixtures with hand-computed expectations."""

from __future__ import annotations

import datetime as dt

import pytest

from studylens.functions import columns as X
from studylens.operators import audit, catalog, classroom, concentration, daily, evidence, graph, matrix, paths, progression, quality, ratings
from studylens.sources import ingest, sinks

T0 = dt.datetime(2025, 1, 1, 8)
SCHEMA = (
    "event_id long, created_at timestamp_ntz, date_utc date, user_id string, classroom_id string, playlist_or_module_id string, objective_id string, objective_label string, activity_id string, "
    "activity_label string, exercise_id string, data_correct boolean, data_duration double, session_duration double, work_mode string, attempt_number int, student_attempt_index int, module_id string, module_code string, module_label string"
)
DEFAULTS = {
    "classroom_id": "c1", "playlist_or_module_id": "m1", "objective_id": "o1", "objective_label": "O1", "activity_id": "a1", "activity_label": "A1", "exercise_id": "e1", "data_correct": True, "data_duration": 10.0,
    "session_duration": None, "work_mode": "zpdes", "attempt_number": 1, "module_id": "m1", "module_code": "M1", "module_label": "Module 1", "user_id": "u1",
}


def attempts(spark, rows):
    out, index = [], {}
    for i, r in enumerate(rows):
        r = {**DEFAULTS, **r}
        at = r.pop("created_at", T0 + dt.timedelta(minutes=r.pop("minute", i)))
        index[r["user_id"]] = index.get(r["user_id"], 0) + 1
        r |= {"event_id": i, "created_at": at, "date_utc": at.date(), "student_attempt_index": index[r["user_id"]]}
        out.append(tuple(r[c.split()[0]] for c in SCHEMA.split(", ")))
    return spark.createDataFrame(out, SCHEMA)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_first_attempts_and_repeats(spark):
    df = attempts(spark, [{}, {"attempt_number": 2, "data_correct": False}, {"user_id": "u2"}])
    r = one(daily.activity_daily(df))
    assert (r.attempts, r.first_attempt_count, r.first_attempt_success_rate, r.unique_students) == (3, 2, 1.0, 2)
    r = one(daily.activity_daily(attempts(spark, [{"attempt_number": i + 1, "data_correct": i > 1} for i in range(4)])))
    assert (r.repeat_attempt_rate, r.retry_before_success_rate) == (0.75, 0.5)


def test_null_students_count_as_one(spark):
    r = one(daily.activity_daily(attempts(spark, [{"user_id": None}, {"user_id": None}, {}])))
    assert r.unique_students == 2


def test_playlist_rows_without_module(spark):
    df = attempts(spark, [{"playlist_or_module_id": "p", "work_mode": "playlist"}, {"playlist_or_module_id": "p", "work_mode": "playlist", "module_id": None, "module_code": None, "module_label": None}])
    r = one(daily.playlist_module_usage(df))
    assert (r.module_code, r.attempts, r.work_mode) == ("M1", 1, "playlist")


def test_bottleneck_labels_collide(spark):
    df = attempts(spark, [{"activity_id": f"a{i}", "activity_label": "same", "module_code": m} for i, m in enumerate(["M1", "M2", "M2"])])
    got = {r.activity_id: r.display_label for r in daily.bottlenecks(daily.activity_daily(df)).collect()}
    assert got == {"a0": "same (M1)", "a1": "same (M2 #a1)", "a2": "same (M2 #a2)"}


def test_normalisers(spark):
    df = spark.createDataFrame([(x,) for x in ["", " None ", "null", "NaN", " x ", "\t", None]], "c string")
    rows = df.select(X.real_id(df.c).alias("i"), X.real_text(df.c).alias("t"), X.real_csv(df.c).alias("s"), X.real_model(df.c).alias("m")).collect()
    assert [r.i for r in rows] == [None, None, None, None, "x", None, None]
    assert [r.t for r in rows] == [None, " None ", "null", "NaN", " x ", None, None]
    assert [r.s for r in rows] == [None, None, None, "NaN", "x", None, None]
    assert [r.m for r in rows] == [None, None, "null", None, "x", None, None]


def test_outcomes(spark):
    df = spark.createDataFrame([(x,) for x in ["1", "0", "0.5", "-1", "nan", "x", None, "true", "False"]], "c string")
    assert [r[0] for r in df.select(X.outcome(df.c)).collect()] == [1.0, 0.0, 1.0, 0.0, None, None, None, 1.0, 0.0]


def test_p_values(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(X.two_sided_p(F.lit(1.959964)).alias("a"), X.two_sided_p(F.lit(0.0)).alias("b")).first()
    assert r.a == pytest.approx(0.05, abs=1e-6) and r.b == pytest.approx(1.0, abs=1e-6)


def test_transitions(spark):
    df = attempts(spark, [{"activity_id": a, "user_id": u} for u, a in [("u1", "a1"), ("u1", "a2"), ("u1", "a3"), ("u2", "a1"), ("u2", "a2")]])
    got = {(r.from_activity_id, r.to_activity_id): r.transition_count for r in paths.transition_edges(df).collect()}
    assert got == {("a1", "a2"): 2, ("a2", "a3"): 1}


MODES = {"u0": ["zpdes", "zpdes"], "u1": ["initial-test", "playlist", "playlist"], "u2": ["initial-test", "zpdes", "playlist", "adaptive-test", "zpdes"], "u3": ["playlist", "adaptive-test", "adaptive-test", "playlist"]}


def test_work_mode_paths(spark):
    df = attempts(spark, [{"user_id": u, "work_mode": m} for u, ms in MODES.items() for m in ms])
    p = paths.work_mode_paths(df)
    got = {r.user_id: (r.total_transitions, r.continues_after_transition_3) for r in p.collect()}
    assert got == {"u0": (0, False), "u1": (1, False), "u2": (4, True), "u3": (2, False)}
    edges = paths.work_mode_edges(p).collect()
    assert sum(r.student_count for r in edges if r.stage == 0) == 4
    assert ("zpdes", "no_transition") in {(r.source, r.target) for r in edges} and ("adaptive-test", "more_than_3") in {(r.source, r.target) for r in edges}


def test_runs(spark):
    df = attempts(spark, [{"exercise_id": f"e{i}", "work_mode": m} for i, m in enumerate(["zpdes", "zpdes", "playlist", "playlist", "zpdes"])])
    got = [(r.run, r.position, r.run_length) for r in paths.trajectories(df).orderBy("event_id").collect()]
    assert got == [(1, 0, 2), (1, 1, 2), (2, 0, 2), (2, 1, 2), (3, 0, 1)]
    assert paths.trajectories(df, min_run=2).count() == 4


def test_segment_progress(spark):
    rows = [{"exercise_id": f"e{i}", "data_correct": c} for i, c in enumerate([False, False, True, True, True])] + [{"user_id": "u2", "exercise_id": f"e{i}", "data_correct": c} for i, c in enumerate([True, False])]
    got = {r.user_id: r.progress for r in paths.segment_progress(paths.trajectories(attempts(spark, rows))).collect()}
    assert got == {"u1": 100.0, "u2": -100.0}


def test_smoothed_start(spark):
    rows = [{"user_id": f"u{i}", "exercise_id": "e1", "data_correct": True} for i in range(1)]
    r = one(ratings.smoothed_start(ratings.calibration_rows(attempts(spark, rows))))
    assert r.rating == pytest.approx(1500.0)
    rows = [{"exercise_id": "e1", "data_correct": True}, {"exercise_id": "e2", "data_correct": False, "user_id": "u2"}, {"exercise_id": "e2", "data_correct": False, "user_id": "u3"}]
    got = {r.exercise_id: r for r in ratings.smoothed_start(ratings.calibration_rows(attempts(spark, rows)), by_module=False).collect()}
    assert got["e1"].smoothed_rate == pytest.approx((1 + 20 / 3) / 21) and got["e2"].smoothed_rate == pytest.approx(.3030303030)
    assert got["e1"].smoothed_rate == pytest.approx(.3650793651) and got["e1"].rating < got["e2"].rating
    assert sum(r.rating for r in got.values()) / 2 == pytest.approx(1500)


def _newton(observed, start=1500.0, sign=1):
    import math

    k, prior, r = math.log(10) / 400, 1 / 250**2, start
    for _ in range(16):
        g, h = (r - 1500) * prior, prior
        for other, y in observed:
            p = min(1 - 1e-9, max(1e-9, 1 / (1 + math.exp(k * sign * (other - r)))))
            g += sign * k * (p - y)
            h += k * k * p * (1 - p)
        d = g / h
        r = min(2400, max(600, r - d))
        if abs(d) < 0.01:
            break
    return r


def test_joint_ratings_match_plain_python(spark):
    import random
    from statistics import median

    rng = random.Random(4)
    seen = [(f"u{u}", f"e{e}", rng.random() < 0.3 + 0.1 * e) for u in range(12) for e in range(5) if rng.random() < 0.8]
    df = attempts(spark, [{"user_id": u, "exercise_id": e, "data_correct": y} for u, e, y in seen])
    got = {r.exercise_id: r.rating for r in ratings.joint_ratings(ratings.calibration_rows(df)).collect()}
    items = {r.exercise_id: r.rating for r in ratings.smoothed_start(ratings.calibration_rows(df)).collect()}
    users = {u: 1500.0 for u, _, _ in seen}
    for _ in range(10):
        users = {u: _newton([(items[e], y) for v, e, y in seen if v == u], users[u]) for u in users}
        new = {e: _newton([(users[u], y) for u, f, y in seen if f == e], items[e], -1) for e in items}
        delta = [abs(new[e] - items[e]) for e in items]
        shift = 1500 - sum(new.values()) / len(new)
        items = {e: r + shift for e, r in new.items()}
        users = {u: r + shift for u, r in users.items()}
        if median(delta) < 0.5 and max(delta) < 3:
            break
    assert got == pytest.approx(items, abs=1e-6)


def test_prefix_refit(spark):
    df = attempts(spark, [{"exercise_id": f"e{i % 2}", "data_correct": i != 1, "attempt_number": i // 2 + 1} for i in range(4)])
    items = spark.createDataFrame([("M1", "e0", 1400.0), ("M1", "e1", 1600.0)], "module_code string, exercise_id string, rating double")
    rows = ratings.batch_replay(ratings.replay_rows(df), items).orderBy("attempt_ordinal").collect()
    seen, last = [], 1500.0
    for r, (item, y) in zip(rows, [(1400.0, 1), (1600.0, 0), (1400.0, 1), (1600.0, 1)]):
        assert r.pre == pytest.approx(last)
        seen.append((item, y))
        last = _newton(seen, last)
        assert r.post == pytest.approx(last)


def test_module_change_restarts_ratings(spark):
    df = attempts(spark, [{}, {"exercise_id": "e2"}, {"exercise_id": "e3", "module_code": "M2"}])
    items = spark.createDataFrame([("M1", "e1", 1500.0), ("M1", "e2", 1500.0), ("M2", "e3", 1500.0)], "module_code string, exercise_id string, rating double")
    rows = ratings.sequential_replay(ratings.replay_rows(df), items).collect()
    assert sorted((r.module_code, r.attempt_ordinal, r.pre) for r in rows) == [("M1", 1, 1500.0), ("M1", 2, 1512.0), ("M2", 1, 1500.0)]


def test_rating_at_an_ordinal(spark):
    rows = [("u1", 80, 1580.0), ("u2", 79, 1500.0), ("u3", 81, 1680.0)]
    df = spark.createDataFrame([(u, "M1", i, float(r) if i == 80 else 1500.0) for u, n, r in rows for i in range(1, n + 1)], "user_id string, module_code string, attempt_ordinal int, post double")
    assert {r.user_id: r.rating for r in ratings.rating_at(df, 80).collect()} == {"u1": 1580.0, "u2": None, "u3": 1680.0}


def test_adaptive_block(spark):
    rows = [{"exercise_id": "e1", "work_mode": "adaptive-test"}, {"exercise_id": "e2", "work_mode": "adaptive-test"}, {"exercise_id": "e3"}, {"exercise_id": "e1", "work_mode": "adaptive-test", "attempt_number": 2}]
    items = spark.createDataFrame([("M1", "e1", 1500.0), ("M1", "e2", 1600.0)], "module_code string, exercise_id string, rating double")
    r = one(ratings.block_ratings(attempts(spark, rows), items))
    assert (r.attempts, r.before_practice, r.after_practice) == (3, 2, 1) and r.rating > 1500


def test_progression_counts_and_cohorts(spark):
    plan = [(0, "a1", "x1"), (1, "a2", "y1"), (2, "a2", "y2"), (2, "a3", "z1"), (3, "a3", "z2"), (4, "a1", "x2"), (4, "a3", "z3")]
    df = attempts(spark, [{"minute": m, "activity_id": a, "exercise_id": e} for m, a, e in plan] + [{"minute": 0, "activity_id": "a3", "exercise_id": "z9", "work_mode": "playlist"}])
    ranks = spark.createDataFrame([("M1", "a1", 0), ("M1", "a2", 1), ("M1", "a3", 2)], "module_code string, activity_id string, activity_rank int")
    events = progression.progression_events(df, ranks)
    got = {r.exercise_id: tuple(r[c] for c in r.asDict() if c.startswith("prior_")) for r in events.collect()}
    assert got == {"x1": (0, 0, 0, 0), "y1": (1, 1, 0, 0), "y2": (2, 1, 1, 0), "z1": (2, 2, 0, 0), "z2": (4, 3, 1, 0), "x2": (5, 0, 1, 4), "z3": (5, 3, 2, 0), "z9": (0, 0, 0, 0)}
    table = {(r.work_mode, r.activity_id): r for r in progression.cohorts(events, 1).collect()}
    assert table["zpdes", "a1"].after_event_count == 1 and table["zpdes", "a3"].before_event_count == 1 and table["zpdes", "a3"].in_activity_event_count == 2
    assert {r.activity_id: r.in_activity_event_count for r in progression.cohorts(events, 9).filter("work_mode = 'zpdes'").collect()}["a1"] == 1


def test_concentration(spark):
    df = attempts(spark, [{"activity_id": f"a{i}", "user_id": f"u{j}"} for i in range(5) for j in range(i + 1)])
    rows = concentration.with_deciles(concentration.entities(df, "activity")).collect()
    assert sum(r.attempt_share for r in rows) == pytest.approx(1) and {r.id: r.bucket for r in rows} == {"a4": 1, "a3": 3, "a2": 5, "a1": 7, "a0": 9}
    within = concentration.within_entities(df, "activity").collect()
    assert len(within) == 50 and sum(r.attempts for r in within) == 15
    unmapped = attempts(spark, [{"activity_id": "a9", "activity_label": None, "work_mode": "initial-test"}])
    assert one(concentration.entities(unmapped, "activity")).label == "Unmapped initial-test activity (M1)"


def test_matrix_values(spark):
    df = attempts(spark, [{"exercise_id": "e1", "data_correct": i < 3, "attempt_number": i + 1} for i in range(4)] + [{"exercise_id": "e2"}])
    value = lambda m: one(matrix.cells(df, m)).metric_value
    assert value("success_rate") == pytest.approx(0.8) and value("exercise_balanced_success_rate") == pytest.approx(0.875)
    assert value("repeat_attempt_rate") == pytest.approx(0.6) and value("first_attempt_success_rate") == 1.0 and value("playlist_unique_exercises") == 0
    assert one(matrix.wide(matrix.ordered(matrix.cells(df, "attempts")), 2)).A1 == 5.0


def test_classrooms(spark):
    df = attempts(spark, [{"classroom_id": c, "user_id": u} for c, u in [("c1", "u1"), ("c1", "u2"), ("None", "u3"), (None, "u4")]])
    assert {r.classroom_id for r in classroom.effective_classrooms(df).collect()} == {"c1"}
    none = attempts(spark, [{"classroom_id": None}, {"classroom_id": "None", "user_id": "u2"}])
    assert {r.classroom_id for r in classroom.effective_classrooms(none).collect()} == {classroom.ALL_STUDENTS}
    frames = classroom.replay_frames(attempts(spark, [{"exercise_id": f"e{i}", "data_correct": i % 2 == 0} for i in range(25)]), step=10).orderBy("frame").collect()
    assert [(r.frame, r.cutoff, r.attempts, r.successes) for r in frames] == [(1, 10, 10, 5), (2, 20, 20, 10), (3, 25, 25, 13)]


def test_graphs(spark):
    path = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(5)], "a string, b string")
    assert graph.two_core(path).count() == 0
    ring = path.unionByName(spark.createDataFrame([("n5", "n0"), ("n0", "z")], "a string, b string"))
    assert graph.two_core(ring).count() == 6
    two = path.unionByName(spark.createDataFrame([("x", "y")], "a string, b string"))
    assert sorted(r["size"] for r in graph.component_sizes(graph.components(two), two.selectExpr("a as node").union(two.selectExpr("b"))).collect()) == [2, 6]
    nodes = spark.createDataFrame([(m, n) for m, ns in {"L": "abc", "D": "abcd", "C": "ab", "T": "abc", "G": "abcd"}.items() for n in ns], "module_code string, node string")
    edges = spark.createDataFrame([("L", "a", "b"), ("L", "b", "c"), ("D", "a", "b"), ("D", "c", "d"), ("C", "a", "b"), ("C", "b", "a"), ("T", "a", "b"), ("T", "a", "c"), ("G", "a", "b"), ("G", "a", "c"), ("G", "b", "d"), ("G", "c", "d")], "module_code string, source string, target string")
    assert {r.module_code: r.topology for r in graph.topology(nodes, edges).collect()} == {"L": "linear", "D": "disconnected_dag", "C": "cyclic", "T": "tree", "G": "general_dag"}
    focus = graph.focus(edges.filter("module_code = 'G'"), "b").collect()
    assert {(r.node, r.relation) for r in focus} == {("a", "ancestor"), ("d", "child")}


def test_nearest_percentiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    r = one(audit.distribution(df, "v", "x"))
    assert (r.p10, r.p25, r.p50, r.p75, r.p90) == (1.0, 2.0, 4.0, 7.0, 8.0)


def test_researcher_lines(spark):
    good = ",".join(f"v{i}" for i in range(21))
    lines = spark.createDataFrame([(good + ";;",), (",".join(["v"] * 17 + ["1", "2", "3"] + ["s", "t", "u"]) + ";",), ("too,short",), (good.replace("v17", '"a,b"'),)], "value string")
    rows = ingest.researcher_rows(lines, ingest.REQUIRED)
    assert [(r.row_state, r.data_answer) for r in rows.collect()] == [("ok", "v17"), ("repaired", "1,2,3"), ("skipped", None), ("ok", "a,b")]
    with pytest.raises(ValueError, match="missing"):
        ingest.researcher_rows(lines, ingest.REQUIRED[1:])


def test_filtered_queries(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert ingest.filtered(df, ["y"], [("x", "in", [])]).collect() == [] and ingest.filtered(df, ["y"], [("x", "in", [])]).columns == ["y"]
    assert [r.y for r in ingest.filtered(df, ["y"], order=[("y", True)]).collect()] == [None, "a"]
    with pytest.raises(ValueError):
        ingest.filtered(df, ["z"])
    with pytest.raises(ValueError):
        ingest.filtered(df, ["x"], [("x", "like", "a")])


CATALOG = {
    "modules": [{"id": "m1", "code": "M1", "title": {"short": "Mod", "long": "Module"}, "objectives": [{"id": "o1", "code": "M1O1", "title": {"short": None, "long": "Obj"}, "activities": [{"id": "a1", "code": "M1O1A1", "title": None, "exercise_ids": ["e1", " ", "e2"]}, {"id": None, "code": "x", "title": None, "exercise_ids": ["e9"]}]}]}],
    "id_label_index": {"m1": {"type": "module", "code": "M1", "short_title": "Mod"}, "o1": {"type": "objective", "code": "M1O1", "long_title": "Obj"}, "a1": {"type": "activity", "code": "M1O1A1"}},
    "exercise_to_hierarchy": {"e1": {"activity_id": "a1", "objective_id": "o1", "module_id": "m1"}},
    "conflicts": ["c"],
}
RULES = {"map_id_code": {"code_to_id": {"M1": "m1", "M1O1": "o1"}, "id_to_codes": {"m1": ["M1"], "o1": ["M1O1", "M1"]}}, "module_rules": [{"module_code": "M1", "node_code": "M1O1A2", "requirements": "M1O1A1(75%) M1O9", "deact_requirements": None, "init_open": None}, {"module_code": "M1", "node_code": "M1O1A1", "requirements": None, "deact_requirements": "M1O1A2", "init_open": True}]}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    import json

    folder = tmp_path_factory.mktemp("metadata")
    for name, value in (("catalog", CATALOG), ("rules", RULES)):
        (folder / f"{name}.json").write_text(json.dumps(value))
    return folder


def test_catalog_file(spark, files):
    nested = catalog.load_catalog(spark, str(files / "catalog.json"))
    full = catalog.hierarchy(nested)
    assert sorted(r.exercise_id for r in full.collect()) == ["e1", "e2"] and {r.objective_label for r in full.collect()} == {"Obj"}
    assert {r.id: r.label for r in catalog.label_index(nested).collect()} == {"m1": "Mod", "o1": "Obj", "a1": "M1O1A1"}
    named = one(catalog.exercise_map(catalog.frames(nested)["exercise_hierarchy"], catalog.label_index(nested)))
    assert (named.module_code, named.objective_label, named.activity_label) == ("M1", "Obj", "M1O1A1")
    assert one(quality.health(nested)).conflicts == 1
    assert {r.exercise_id for r in quality.nested_against_flat(full, catalog.frames(nested)["exercise_hierarchy"]).collect()} == {"e2"}


def test_rules_file(spark, files):
    rules = catalog.load_rules(spark, str(files / "rules.json"))
    assert {r.id: r.code for r in catalog.preferred_codes(rules).collect()} == {"m1": "M1", "o1": "M1O1"}
    edges = catalog.requirement_edges(rules)
    assert {(r.source, r.target, r.kind, r.threshold) for r in edges.collect()} == {("M1O1A1", "M1O1A2", "activation", 75), ("M1O9", "M1O1A2", "activation", None), ("M1O1A2", "M1O1A1", "deactivation", None)}
    nodes = {r.node: (r.init_open, r.ghost) for r in catalog.dependency_nodes(rules, edges).collect()}
    assert nodes == {"M1O1A1": (True, False), "M1O1A2": (False, False), "M1O9": (True, True)}
    assert {(r.code, r.id) for r in quality.reciprocity(rules).collect()} == {("M1", "o1")}


def test_resolution(spark, files):
    full = catalog.hierarchy(catalog.load_catalog(spark, str(files / "catalog.json")))
    codes = spark.createDataFrame([("o1", "M1O1"), ("a1", "M1O1A1")], "id string, code string")
    rows = [{"playlist_or_module_id": "None", "objective_id": "None", "activity_id": "nan"}, {"playlist_or_module_id": "m1", "objective_id": "o1", "activity_id": "a1"}, {"playlist_or_module_id": "None", "objective_id": "zz", "activity_id": "yy", "exercise_id": "e7"}, {"playlist_or_module_id": None, "objective_id": "o1", "activity_id": None}]
    got = {r.event_id: r for r in catalog.resolve(attempts(spark, rows), full, codes).collect()}
    assert (got[0].module_code, got[0].objective_id, got[0].activity_id, got[0].resolution_source_module) == ("M1", "o1", "a1", "exercise")
    assert (got[1].resolution_source_module, got[1].resolution_source_activity, got[1].objective_label) == ("direct", "direct", "Obj")
    assert (got[2].module_code, got[2].objective_id, got[2].objective_label, got[2].resolution_source_objective) == (None, "zz", None, "raw_id")
    assert (got[3].module_code, got[3].resolution_source_module, got[3].activity_id) == ("M1", "context", "a1")


def test_build_and_profiles(spark, tmp_path):
    df = attempts(spark, [{}, {"exercise_id": "e2", "activity_id": "a2", "data_correct": False}, {"user_id": "u2"}])
    manifest = {r.table_name: r.rows for r in sinks.build(spark, df, str(tmp_path), ["agg_activity_daily", "progression_events", "student_selection_profiles"]).collect()}
    assert manifest == {"agg_activity_daily": 2, "progression_events": 3, "student_selection_profiles": 2}
    with pytest.raises(ValueError, match="lacks"):
        sinks.check_contract(df.drop("activity_id"), "progression_events")
    for kind in ("csv", "json", "parquet"):
        sinks.export(df.select("user_id"), f"{tmp_path}/out.{kind}")
    nulls = {r.column_name: r.nulls for r in sinks.snapshot(df).collect()}
    assert nulls["session_duration"] == 3 and nulls["user_id"] == 0


def test_clustered_ols(spark):
    rows = [(f"g{i % 3}", f"k{i % 7}", float(i % 5), float(2 * (i % 5) + 10 * (i % 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "module string, class string, x double, y double")
    r = one(evidence.clustered_ols(df, "y", ["x"], "module", "class"))
    assert r.estimate == pytest.approx(2.0) and r.std_error == pytest.approx(0.0, abs=1e-9)


def test_module_tails(spark):
    dense = [f"f{i:02}" for i in range(1, 12)]
    taken = [("u1", "M1", ["e1", "e2", "e3", "e4"]), ("u2", "M1", ["e4", "e3", "e2", "e1"]), ("u3", "M1", ["e5", "e6"]), ("u4", "M1", ["e6", "e5"]), ("u5", "M1", ["e7"]), ("u6", "M1", ["e8"]), ("u7", "M2", dense), ("u8", "M2", dense[::-1]), ("u9", "M2", ["f01", "f12"])]
    df = attempts(spark, [{"user_id": u, "module_code": m, "exercise_id": e} for u, m, es in taken for e in es])
    got = {(r.module_code, r.exercise_id): (r.degree, r.component_exercises) for r in audit.module_tails(paths.progress_quantiles(paths.first_exposures(df))).collect()}
    # small component of more than the module's p10 degree, exercises without neighbours, and a denser module's own cut
    assert got == {("M1", "e5"): (1, 2), ("M1", "e6"): (1, 2), ("M1", "e7"): (0, 1), ("M1", "e8"): (0, 1)} | {("M2", e): (10, 12) for e in dense[1:]} | {("M2", "f12"): (1, 12)}


def _joint(seen, items):
    """ELO-5 in plain Python from (student, exercise, outcome) of one module."""
    from statistics import median

    users = {u: 1500.0 for u, _, _ in seen}
    for _ in range(10):
        users = {u: _newton([(items[e], y) for v, e, y in seen if v == u], users[u]) for u in users}
        new = {e: _newton([(users[u], y) for u, f, y in seen if f == e], items[e], -1) for e in items}
        delta, shift = [abs(new[e] - items[e]) for e in items], 1500 - sum(new.values()) / len(new)
        items = {e: r + shift for e, r in new.items()}
        users = {u: r + shift for u, r in users.items()}
        if median(delta) < 0.5 and max(delta) < 3:
            break
    return items


def _iterative(seen, items):
    """ELO-6 in plain Python: replay, golden-section search per exercise, mean back to 1500."""
    import math
    from statistics import median

    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(10):
        now, pre = {}, {e: [] for e in items}
        for u, e, y in seen:
            r = now.get(u, 1500.0)
            pre[e].append((r, y))
            now[u] = r + 24 * (y - 1 / (1 + 10 ** ((items[e] - r) / 400)))

        def loss(e, r):
            ps = [(1 / (1 + 10 ** ((r - a) / 400)), y) for a, y in pre[e]]
            return -sum(math.log(p if y else 1 - p) for p, y in ps) + 0.5 * ((r - 1500) / 200) ** 2

        new = {}
        for e in items:
            a, b = 600.0, 2400.0
            for _ in range(40):
                c, d = b - ratio * (b - a), a + ratio * (b - a)
                a, b = (a, d) if loss(e, c) <= loss(e, d) else (c, b)
            new[e] = (a + b) / 2
        mean = sum(new.values()) / len(new)
        new = {e: r - mean + 1500 for e, r in new.items()}
        delta, items = [abs(new[e] - items[e]) for e in items], new
        if median(delta) < 1 and max(delta) < 5:
            break
    return items


def test_queries_read_calibrated_ratings(spark, monkeypatch):
    import random

    from studylens.plans import registry  # noqa: F401, loads the plans in their order
    from studylens.plans import ratings as plan

    rng = random.Random(7)
    seen = [(f"u{u:02}", f"e{e}", rng.random() < 0.9 - 0.15 * e) for u in range(12) for e in range(5) if rng.random() < 0.8]
    df = attempts(spark, [{"user_id": u, "exercise_id": e, "data_correct": y, "work_mode": "adaptive-test"} for u, e, y in seen]).cache()
    monkeypatch.setattr(plan, "attempts", lambda spark, sf_dir: df)
    joint = _joint(seen, {r.exercise_id: r.rating for r in ratings.smoothed_start(ratings.calibration_rows(df)).collect()})
    iterative = _iterative(seen, {r.exercise_id: r.rating for r in ratings.smoothed_start(ratings.calibration_rows(df), by_module=False).collect()})
    assert {r.exercise_id: r.item_rating for r in plan.elo_batch_replay(spark, "").collect()} == pytest.approx(joint, abs=1e-6)
    users = {u: _newton([(joint[e], y) for v, e, y in seen if v == u]) for u, _, _ in seen}
    assert {r.user_id: r.rating for r in plan.adaptive_block_elo(spark, "").collect()} == pytest.approx(users, abs=1e-6)
    assert {r.exercise_id: r.exercise_elo for r in plan.exercise_elo_calibrated(spark, "").collect()} == pytest.approx(joint, abs=1e-6)
    got = {r.exercise_id: (r.current_elo, r.iterative_elo, r.elo_diff) for r in plan.elo_exercise_shifts(spark, "").collect()}
    for e in joint:
        assert got[e] == pytest.approx((joint[e], iterative[e], iterative[e] - joint[e]), abs=1e-3)

    def replay(items, u):
        r, out = 1500.0, []
        for v, e, y in seen:
            if v == u:
                r += 24 * (y - 1 / (1 + 10 ** ((items[e] - r) / 400)))
                out.append(r)
        return out

    aligned = {(r.user_id, r.attempt_ordinal): r.left_rating for r in plan.elo_aligned_systems(spark, "").collect()}
    for r in plan.elo_student_gaps(spark, "").collect():
        left = replay(joint, r.user_id)
        assert [aligned[r.user_id, i + 1] for i in range(len(left))] == pytest.approx(left, abs=1e-6)
        gaps = [b - a for a, b in zip(left, replay(iterative, r.user_id))]
        k = max(1, len(gaps) // 3)
        size = [abs(g) for g in gaps]
        assert (r.final_gap, r.early_abs_gap, r.late_abs_gap) == pytest.approx((gaps[-1], sum(size[:k]) / k, sum(size[-k:]) / k), abs=1e-3)


def test_shift_summary(spark):
    rows = [("M1", f"e{i}", i, 1500.0, 1500.0 + s, float(s), float(abs(s))) for i, s in zip([10, 20, 30, 40, 50], [-30, 10, 5, -8, 2])]
    r = one(ratings.shift_summary(spark.createDataFrame(rows, "module_code string, exercise_id string, calibration_attempts long, current_elo double, iterative_elo double, elo_diff double, abs_elo_diff double")))
    assert (r.exercises, r.median_abs_shift, r.mean_shift, r.q25_attempts, r.q75_attempts, r.sparse_median_shift, r.dense_median_shift) == (5, 8.0, pytest.approx(-4.2), 20, 40, 20.0, 5.0)


def test_ranks_over_several_partitions(spark):
    from pyspark.sql import functions as F

    from studylens.functions.rank import rank_by_range

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(1000).select((F.col("id") % 3).alias("n"), F.format_string("%04d", "id").alias("path"))
        out = rank_by_range(rows, F.desc("n"), F.asc("path"))
        assert len({r[0] for r in out.select(F.spark_partition_id()).distinct().collect()}) > 1
        got = [(r.n, r.path) for r in sorted(out.collect(), key=lambda r: r["rank"])]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(got, key=lambda x: (-x[0], x[1])) and [r[0] for r in out.select("rank").orderBy("rank").collect()] == list(range(1, 1001))


def test_designs_and_paths_stay_in_several_partitions(spark):
    from pyspark.sql import functions as F

    from studylens.operators import slices

    df = attempts(spark, [{"user_id": f"u{i % 20:02}", "classroom_id": None if i % 20 == 3 else f"c{i % 2}", "exercise_id": f"e{i}", "activity_id": f"a{i % 20}" if i < 20 else "a"} for i in range(40)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for make in (lambda: slices.path_findings(df), lambda: evidence.design(paths.trajectories(df))):
            assert len({r["part"] for r in make().withColumn("part", F.spark_partition_id()).collect()}) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {(r.user_id, r.student_code) for r in evidence.design(paths.trajectories(df)).collect()}
    assert got == {(f"u{i:02}", i + 1) for i in range(20)}
