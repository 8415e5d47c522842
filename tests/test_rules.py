"""Null outcomes, contexts of ratings, dependency focus, adapters and files, on literal fixtures."""

from __future__ import annotations

import json

import pytest

from studylens.functions import columns as X
from studylens.operators import audit, classroom, daily, evidence, graph, matrix, paths, quality, ratings
from studylens.sources import adapters, ingest, sinks

from .test_operators import _joint, attempts, one


def test_unknown_outcomes_are_no_failures(spark):
    df = attempts(spark, [{}, {"data_correct": None, "attempt_number": 2}])
    assert one(daily.activity_daily(df)).success_rate == 1.0 and one(daily.objective_daily(df)).success_rate == 1.0
    assert one(daily.student_module_progress(df)).success_rate == 1.0 and one(daily.work_mode_summary(df)).success_rate == 1.0
    assert one(matrix.cells(df, "success_rate")).metric_value == 1.0 and one(audit.success_band(df, "user_id")).mean_rate == 1.0
    ctx = {r.event_id: r.retry_before_success_flag for r in daily.attempt_context(attempts(spark, [{"data_correct": None}, {"attempt_number": 2}, {"attempt_number": None}])).collect()}
    assert ctx == {0: 0, 1: 1, 2: 0}


def test_bottlenecks_with_unknown_days_and_missing_ids(spark):
    daily_rows = [("a1", 10, 0.5, 0.2, 0.1), ("a1", 10, None, 0.4, 0.3), (None, 5, 0.0, 1.0, 1.0)]
    names = "module_id string, module_code string, module_label string, objective_id string, objective_label string, activity_id string, activity_label string, attempts long, success_rate double, repeat_attempt_rate double, retry_before_success_rate double"
    r = one(daily.bottlenecks(spark.createDataFrame([("m", "M1", "M", "o", "O", a, a, *rest) for a, *rest in daily_rows], names)))
    assert (r.activity_id, r.attempts) == ("a1", 20) and r.failure_rate == pytest.approx(0.25) and r.bottleneck_score == pytest.approx(10 * (0.35 + 0.03) / 20)


def test_playlist_usage_keeps_attempts_without_playlist(spark):
    rows = [{"playlist_or_module_id": None}, {"playlist_or_module_id": None, "classroom_id": "c2", "data_correct": False}, {}]
    got = {r.playlist_or_module_id: (r.attempts, r.unique_classrooms, r.success_rate) for r in daily.playlist_module_usage(attempts(spark, rows)).collect()}
    assert got == {None: (2, 2, 0.5), "m1": (1, 1, 1.0)}


def test_a_next_attempt_without_activity_is_no_edge(spark):
    edges = paths.transition_edges(attempts(spark, [{}, {"activity_id": None}, {"activity_id": "a2"}])).collect()
    assert [(r.from_activity_id, r.to_activity_id, r.from_module_id, r.from_module_label) for r in edges] == [(None, "a2", "m1", "Module 1")]


def test_two_most_active_students(spark):
    df = attempts(spark, [{"user_id": u} for u in ["u1"] * 5 + ["u2"] * 3 + ["u3"] * 2])
    assert one(classroom.classroom_findings(df)).top_two_share == pytest.approx(0.8)


def test_histogram_percentiles(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (5, 6)], "v int, k long")
    r = one(audit.histogram_distribution(df, "v", "k", "x"))
    assert (r.n, r["mean"], r.p10, r.p30, r.p40, r.p50, r.max) == (10, 3.5, 1.0, 1.0, 2.0, 5.0, 5.0) and r.sd == pytest.approx(((3 * 2.5**2 + 1.5**2 + 6 * 1.5**2) / 10) ** 0.5)


def test_an_exercise_is_rated_in_its_context(spark):
    df = attempts(spark, [{"user_id": f"u{i}", "activity_id": a, "data_correct": a == "a1"} for i in range(8) for a in ("a1", "a2")])
    items = {r.activity_id: r.rating for r in ratings.joint_ratings(ratings.calibration_rows(df)).collect()}
    seen = [(f"u{i}", a, a == "a1") for i in range(8) for a in ("a1", "a2")]
    start = {r.activity_id: r.rating for r in ratings.smoothed_start(ratings.calibration_rows(df)).collect()}
    assert items == pytest.approx(_joint(seen, start), abs=1e-6) and items["a1"] < 1500 < items["a2"]
    replay = ratings.sequential_replay(ratings.replay_rows(df), ratings.joint_ratings(ratings.calibration_rows(df))).collect()
    assert {(r.activity_id, round(r.item_rating, 6)) for r in replay} == {(a, round(x, 6)) for a, x in items.items()}
    base = ratings.item_base(df)
    assert {(r.activity_id, r.calibrated_exercises) for r in ratings.activity_ratings(base, ratings.joint_ratings(ratings.calibration_rows(df))).collect()} == {("a1", 1), ("a2", 1)}


def test_fits_of_very_common_items_and_students_are_the_same(spark, monkeypatch):
    import random

    rng = random.Random(3)
    df = attempts(spark, [{"user_id": f"u{u}", "exercise_id": f"e{e}", "data_correct": rng.random() < 0.6} for u in range(6) for e in range(4)])
    rows, replay = ratings.calibration_rows(df), ratings.replay_rows(df)
    monkeypatch.setattr(ratings, "BATCH_ROUNDS", 2)
    whole = {r.exercise_id: r.rating for r in ratings.joint_ratings(rows, 1).collect()}
    loop = {r.exercise_id: r.rating for r in ratings.iterative_ratings(replay, 1).collect()}
    monkeypatch.setattr(ratings, "FOLD_ROWS", 4)
    monkeypatch.setattr(ratings, "NEWTON_STEPS", 6)
    monkeypatch.setattr(ratings, "GOLDEN_STEPS", 25)
    assert {r.exercise_id: r.rating for r in ratings.joint_ratings(rows, 1).collect()} == pytest.approx(whole, abs=1e-2)
    assert {r.exercise_id: r.rating for r in ratings.iterative_ratings(replay, 1).collect()} == pytest.approx(loop, abs=0.1)


def test_focus_takes_objectives_and_long_chains(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)] + [("O1", "O2"), ("n70", "child")], "source string, target string")
    places = spark.createDataFrame([("n70", "O2"), ("n3", None)], "node string, objective string")
    got = {(r.node, r.relation) for r in graph.focus(chain, "n70", places).collect()}
    assert got == {(f"n{i}", "ancestor") for i in range(70)} | {("O1", "ancestor"), ("O2", "ancestor"), ("child", "child")}


def test_ordinals_do_not_depend_on_the_order_of_rows(spark):
    df = attempts(spark, [{"minute": 0, "data_duration": float(i)} for i in range(6)]).drop("student_attempt_index", "attempt_number")
    number = lambda d: {r.event_id: (r.student_attempt_index, r.attempt_number) for r in ingest.with_ordinals(d).collect()}
    assert number(df) == number(df.orderBy("event_id", ascending=False).repartition(3))


def test_html_text(spark):
    df = spark.createDataFrame([("<p>A&nbsp;&lt;b&gt; c&amp;lt;d</p>\n <i>&eacute;t&eacute;</i>",), ("",), (None,)], "h string")
    assert [r[0] for r in df.select(X.html_text(df.h)).collect()] == ["A c&lt;d été", "", None]


def test_probability_curve(spark):
    rows = spark.createDataFrame([("zpdes", 0), ("playlist", 2)], "work_mode string, position int")
    terms = [("intercept", 0.0), ("zpdes", 1.0), ("position", 0.5), ("interaction", 9.0)]
    fitted = spark.createDataFrame(terms, "term string, estimate double")
    got = {r.work_mode: r.linear_predictor for r in evidence.probability_curve(rows, fitted).collect()}
    assert got == {"zpdes": 1.0, "playlist": 1.0}
    with pytest.raises(Exception, match="no coefficient interaction"):
        evidence.probability_curve(rows, fitted.filter("term <> 'interaction'")).collect()


def test_individual_findings(spark):
    plan = [("a1", True), ("a1", None), (None, True), ("a2", False), ("zz", True), ("a1", True), ("a3", True)]
    df = attempts(spark, [{"activity_id": a, "data_correct": y} for a, y in plan])
    mapped = spark.createDataFrame([("a1",), ("a2",), ("a3",)], "activity_id string")
    r = one(paths.individual_findings(df, 6, mapped))
    assert (r.visible_attempts, r.mapped_attempts, r.unmapped_attempts, r.mapped_activities, r.mapped_success_rate, r.recent_moves) == (6, 4, 2, 2, 0.5, "a1 -> a2 | a2 -> a1")


def test_drilldown_forms(spark):
    df = attempts(spark, [{"work_mode": "playlist"}, {}, {"exercise_id": "e2"}])
    items = spark.createDataFrame([("M1", "e1", 1512.5)], "module_code string, exercise_id string, rating double")
    assert {(r.exercise_id, r.metric_text) for r in matrix.drilldown(df, "activity_mean_exercise_elo", ratings=items).collect()} == {("e1", "1512"), ("e2", "not calibrated")}
    assert [(r.exercise_id, r.metric_text) for r in matrix.drilldown(df, "playlist_unique_exercises").collect()] == [("e1", "1 playlist attempts")]
    assert {r.exercise_id: r.attempts for r in matrix.drilldown(df, "attempts", mode="zpdes").collect()} == {"e1": 1, "e2": 1}


UUID = "0000000{}-0000-0000-0000-00000000000{}"


def test_configuration_files(spark, tmp_path):
    ids = [UUID.format(i, i) for i in range(4)]
    (tmp_path / "config.csv").write_text("type;id;code;short_title;long_title;learning_items\nModule;m1;M1;Mod;;\nobjective;o1;M1O1;;Obj;\nactivity;a1;M1O1A1;;;['" + f"{ids[0]}', '{ids[1]}']\nnote;x;y;;;\nactivity;a9;M7O1A1;;;\n")
    rows = ingest.config_csv(spark, str(tmp_path / "config.csv"))
    assert {r.type for r in rows.collect()} == {"module", "objective", "activity"}
    assert {r.id: r.parent_id for r in ingest.config_parents(rows).collect()} == {"m1": None, "o1": "m1", "a1": "o1", "a9": None}
    tree = {"module": {"x": {"id": "m1", "code": "M1", "title": {"short": "Mod"}}}, "objective": {"x": {"id": "o1", "code": "M1O1"}}, "activity": {"x": {"id": "a1", "code": "M1O1A1", "learning_items": ["e1", " "]}, "y": {"id": "a2", "code": "M1O1A2"}, "z": {"id": "a3", "code": "M2O1A1"}}}
    (tmp_path / "config.json").write_text(json.dumps(tree))
    full = adapters.config_hierarchy(adapters.config_json(spark, str(tmp_path / "config.json")))
    assert sorted((r.activity_id, r.objective_id, r.module_label, r.exercise_id or "") for r in full.collect()) == [("a1", "o1", "Mod", "e1"), ("a2", "o1", "Mod", "")]

    def line(user, objective, activity, exercise, playlist="m1"):
        cells = {"user_id": user, "objective_id": objective, "activity_id": activity, "exercise_id": exercise, "playlist_or_module_id": playlist, "created_at": "2025-01-01T08:00:00", "data_correct": "true", "work_mode": "zpdes"}
        return ",".join(cells.get(c, "") for c in ingest.REQUIRED) + ";"

    folder = tmp_path / "lines"
    folder.mkdir()
    head = ",".join(ingest.REQUIRED) + ";;"
    (folder / "a.csv").write_text("\n".join([head, line("u1", "o1", "a1", "e1"), line("u1", "o1", "a8", "e8")]))
    (folder / "b.csv").write_text("\n".join([head, line("u2", "o9", "a9", "e9"), line("u2", "", "", "e1", ""), line("u2", "", "", "e0", "")]))
    found, places = ingest.ingest(spark, "multi_module", attempts=str(folder), config=str(tmp_path / "config.json"))
    got = {(r.user_id, r.exercise_id): (r.activity_id, r.objective_id, r.module_id) for r in found.collect()}
    assert got == {("u1", "e1"): ("a1", "o1", "m1"), ("u1", "e8"): ("a8", "o1", "m1"), ("u2", "e9"): ("a9", "o9", "m1"), ("u2", "e1"): ("a1", "o1", "m1"), ("u2", "e0"): (None, None, None)}
    codes = {r.activity_id: (r.objective_code, r.activity_code) for r in places.collect()}
    assert codes == {"a1": ("M1O1", "M1O1A1"), "a2": ("M1O1", "M1O1A2"), "a8": ("M1O1", "M1O1A3"), "a9": ("M1O2", "M1O2A1")}
    found, places = ingest.ingest(spark, "module_config", attempts=str(folder), config=str(tmp_path / "config.csv"))
    assert {(r.module_id, r.module_code, r.module_label) for r in found.collect()} == {("m1", "M1", "Mod")}
    assert {r.exercise_id for r in places.collect()} == set(ids[:2])
    assert {r.activity_id for r in ingest.orphans(found, places).collect()} == {"a8", "a9"}


def test_stored_classroom_profiles(spark, tmp_path):
    df = attempts(spark, [{}, {"user_id": "u2"}])
    built = sinks.classroom_profiles(spark, f"{tmp_path}/none", df)
    assert {r.students for r in built.collect()} == {2}
    built.withColumn("students", built.students + 5).write.parquet(f"{tmp_path}/stored")
    assert {r.students for r in sinks.classroom_profiles(spark, f"{tmp_path}/stored", df).collect()} == {7}
    built.drop("students").write.parquet(f"{tmp_path}/short")
    assert {r.students for r in sinks.classroom_profiles(spark, f"{tmp_path}/short", df).collect()} == {2}


def test_all_tables_build(spark, tmp_path):
    df = attempts(spark, [{"user_id": f"u{i % 3}", "exercise_id": f"e{i % 4}", "attempt_number": 1 + (i > 8), "data_correct": i % 2 == 0} for i in range(12)])
    manifest = {r.table_name: r.rows for r in sinks.build(spark, df, str(tmp_path)).collect()}
    assert set(manifest) == set(sinks.BUILDERS) and all(manifest.values())
    for kind in ("csv", "json", "parquet"):
        path = f"{tmp_path}/out.{kind}"
        sinks.export(df.select("event_id", "user_id"), path)
        back = {"csv": lambda: spark.read.option("header", True).csv(path), "json": lambda: spark.read.json(path), "parquet": lambda: spark.read.parquet(path)}[kind]()
        assert {(int(r.event_id), r.user_id) for r in back.collect()} == {(r.event_id, r.user_id) for r in df.collect()}


def test_quality_of_ids(spark):
    full = spark.createDataFrame([("m1", "o1", "a1", "e1"), ("m1", "o1", "a2", "e1"), ("m1", "o2", "a3", "e3")], "module_id string, objective_id string, activity_id string, exercise_id string")
    assert [(r.level, r.id, r.parents) for r in quality.duplicate_ids(full).collect()] == [("exercise_id", "e1", 2)]
    assert {r.exercise_id for r in quality.unattempted(attempts(spark, [{}]), full).collect()} == {"e3"}
