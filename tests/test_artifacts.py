"""Stored tables under their contracts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from studylens.sources import artifacts, sinks

from .test_operators import attempts, one


def tables(spark):
    rows = [{"user_id": f"u{i % 3}", "exercise_id": f"e{i % 4}", "activity_id": f"a{i % 2}", "activity_label": f"Activity {i % 2}", "data_correct": i % 3 > 0, "work_mode": ["zpdes", "playlist"][i % 2]} for i in range(12)]
    fact = attempts(spark, rows).withColumns({c: F.lit("direct") for c in artifacts.SOURCES})
    return sinks.Tables(fact)


def test_every_artifact_has_its_contract(spark):
    t = tables(spark)
    for name, columns in artifacts.CONTRACTS.items():
        df = artifacts.artifact(t, name)
        assert df.columns == columns, name
    assert len(artifacts.CONTRACTS) == 22


def test_rated_exercises_keep_their_support(spark):
    t = tables(spark)
    names = spark.createDataFrame([("e1", "First one", "quiz")], "exercise_id string, exercise_label string, exercise_type string")
    got = {r.exercise_id: r for r in artifacts.artifact(t, "agg_exercise_elo", names).collect()}
    assert set(got) == {"e0", "e1", "e2", "e3"}
    assert (got["e1"].exercise_label, got["e1"].exercise_type, got["e2"].exercise_label, got["e2"].exercise_type) == ("First one", "quiz", "e2", "unknown")
    assert all(r.calibrated and r.calibration_attempts == 3 and r.module_label == "Module 1" and r.activity_label == f"Activity {int(r.exercise_id[1]) % 2}" for r in got.values())
    activity = {r.activity_id: r for r in artifacts.artifact(t, "agg_activity_elo").collect()}
    assert (activity["a0"].calibrated_exercise_count, activity["a0"].catalog_exercise_count, activity["a0"].calibration_coverage_ratio, activity["a0"].objective_label) == (2, 2, 1.0, "O1")


def test_rating_events_and_profiles(spark):
    t = tables(spark)
    events = artifacts.artifact(t, "student_elo_events").collect()
    assert len(events) == 12 and {r.work_mode for r in events} == {"zpdes", "playlist"} and all(r.date_utc == r.created_at.date() for r in events)
    profiles = {r.user_id: r for r in artifacts.artifact(t, "student_elo_profiles").collect()}
    last = max((r for r in events if r.user_id == "u0"), key=lambda r: r.attempt_ordinal)
    assert profiles["u0"].final_student_elo == last.student_elo_post and profiles["u0"].eligible_for_replay and (profiles["u0"].total_attempts, profiles["u0"].unique_activities, profiles["u0"].module_label) == (4, 2, "Module 1")


def test_contract_report_and_files(spark, tmp_path):
    t = tables(spark)
    df = artifacts.artifact(t, "agg_module_usage_daily")
    report = {r.column_name: r for r in artifacts.contract_report(df.drop("module_label"), "agg_module_usage_daily").collect()}
    assert not report["module_label"].present and report["module_label"].nulls is None and (report["attempts"].rows, report["attempts"].nulls) == (1, 0)
    with pytest.raises(ValueError, match="lacks"):
        artifacts.artifact(sinks.Tables(t["fact_attempt_core"], known={"agg_module_usage_daily": df.drop("attempts")}), "agg_module_usage_daily")
    assert artifacts.write_artifacts(t, str(tmp_path), ["agg_objective_daily", "zpdes_exercise_progression_events"]) == ["agg_objective_daily", "zpdes_exercise_progression_events"]
    back = spark.read.parquet(f"{tmp_path}/zpdes_exercise_progression_events")
    assert back.columns == artifacts.CONTRACTS["zpdes_exercise_progression_events"] and back.filter("destination_rank = 0").count() > 0
