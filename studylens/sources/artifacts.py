"""The stored tables under the names and columns that their readers rely on.

``sinks`` builds the engine's tables; here each becomes the artifact of its contract: named
columns, labels of its place, rates and ratings with what they rest on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import ratings as R, slices
from .sinks import Tables

# fixed values: columns of the stored tables
MODULE, OBJECTIVE, ACTIVITY = (["module_id", "module_code", "module_label"], ["objective_id", "objective_label"], ["activity_id", "activity_label"])
PLACE = MODULE + OBJECTIVE + ACTIVITY
EXERCISE = ["exercise_id", "exercise_label", "exercise_type"]
SOURCES = ["resolution_source_module", "resolution_source_objective", "resolution_source_activity"]
MEASURES = ["attempts", "unique_students", "success_rate", "first_attempt_success_rate", "first_attempt_count", "median_duration", "repeat_attempt_rate", "retry_before_success_rate", "avg_attempt_number"]
RATED = EXERCISE + PLACE + ["exercise_elo", "calibration_attempts", "calibration_success_rate", "calibrated"]
EVENTS = ["user_id", "attempt_ordinal", "created_at", "date_utc", "work_mode", "module_code", "objective_id", "activity_id", "exercise_id", "outcome", "expected_success", "exercise_elo", "student_elo_pre", "student_elo_post"]
TOTALS = ["total_attempts", "first_attempt_at", "last_attempt_at", "unique_modules", "unique_objectives", "unique_activities", "final_student_elo", "eligible_for_replay"]
PRIOR = [f"prior_{x}attempt_count" for x in ("", "before_activity_", "same_activity_", "later_activity_")]

CONTRACTS: dict[str, list[str]] = {
    "hierarchy_context_lookup": ["playlist_or_module_id", "exercise_id", *PLACE, *SOURCES, "attempts", "unique_students"],
    "classroom_mode_profiles": ["mode_scope", "classroom_id", "students", "activities", "objectives", "modules", "attempts", "first_attempt_at", "last_attempt_at"],
    "classroom_activity_summary_by_mode": ["mode_scope", "activity_label", "classrooms_observed", "attempts_total", "successes_total", "mean_classroom_success_rate", "median_classroom_success_rate", "weak_classroom_count", "success_rate", "weak_classroom_share"],
    "agg_activity_daily": ["date_utc", *PLACE, *MEASURES],
    "agg_objective_daily": ["date_utc", *MODULE, *OBJECTIVE, "attempts", "unique_students", "success_rate", "median_duration", "repeat_attempt_rate"],
    "agg_student_module_progress": ["date_utc", "user_id", *MODULE, "attempts", "unique_activities", "success_rate", "avg_attempt_number", "last_attempt_at"],
    "agg_transition_edges": ["date_utc", "from_activity_id", "from_activity_label", "to_activity_id", "to_activity_label", "transition_count", "success_conditioned_count", "from_module_id", "from_module_code", "from_module_label"],
    "agg_module_usage_daily": ["date_utc", "module_code", "module_label", "attempts", "unique_students"],
    "agg_playlist_module_usage": ["playlist_or_module_id", "module_code", "module_label", "work_mode", "attempts", "unique_students", "unique_classrooms", "unique_activities", "success_rate"],
    "agg_module_activity_usage": ["module_code", "module_label", *ACTIVITY, "attempts", "unique_students", "activity_share_within_module"],
    "agg_exercise_daily": ["date_utc", *PLACE, *EXERCISE, *MEASURES],
    "agg_exercise_elo": RATED,
    "agg_exercise_elo_iterative": RATED,
    "agg_activity_elo": [*PLACE, "activity_mean_exercise_elo", "calibrated_exercise_count", "catalog_exercise_count", "calibration_coverage_ratio"],
    "student_elo_events": EVENTS,
    "student_elo_profiles": ["user_id", *MODULE, *TOTALS],
    "student_elo_events_batch_replay": EVENTS,
    "student_elo_profiles_batch_replay": ["user_id", *MODULE, *TOTALS],
    "student_elo_events_iterative": EVENTS,
    "student_elo_profiles_iterative": ["user_id", *TOTALS],
    "zpdes_exercise_progression_events": ["user_id", "created_at", "date_utc", *PLACE, "exercise_id", "work_mode", "destination_rank", "exercise_first_attempt_outcome", *PRIOR],
    "work_mode_transition_paths": ["user_id", "first_work_mode", "transition_count_total", *[f"transition_{k}_mode" for k in (1, 2, 3)], "continues_after_transition_3"],
}


def _labelled(df: DataFrame, fact: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the place columns it lacks, those that ``keys`` have in the fact (smallest, where there are several)."""
    wanted = [c for c in PLACE if c not in df.columns]
    places = fact.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[F.min(c).alias(c) for c in wanted])
    return df.join(places, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])


def _exercises(df: DataFrame, names: DataFrame | None) -> DataFrame:
    """Label and type of exercises from ``names`` (exercise_id, exercise_label, exercise_type), else the id and "unknown"."""
    df = df.drop("exercise_label", "exercise_type")
    if names is None:
        return df.withColumns({"exercise_label": F.col("exercise_id"), "exercise_type": F.lit("unknown")})
    one = names.groupBy("exercise_id").agg(F.min("exercise_label").alias("exercise_label"), F.min("exercise_type").alias("exercise_type"))
    return df.join(one, "exercise_id", "left").withColumns({"exercise_label": F.coalesce("exercise_label", "exercise_id"), "exercise_type": F.coalesce("exercise_type", F.lit("unknown"))})


def _rated(t: Tables, items: str, observed: DataFrame) -> DataFrame:
    """ELO-7: every exercise of the base with rating, support and flag."""
    table = slices.rating_table(R.item_base(t["fact_attempt_core"]), t[items], observed)
    return _labelled(table, t["fact_attempt_core"], ["module_code", "objective_id", "activity_id"])


def _events(t: Tables, name: str) -> DataFrame:
    """ELO events with day and mode of their attempt."""
    when = t["fact_attempt_core"].select("event_id", "date_utc", "work_mode")
    rows = t[name].join(when, "event_id")
    return rows.select("*", F.col("y").alias("outcome"), F.col("expected").alias("expected_success"), F.col("item_rating").alias("exercise_elo"), F.col("pre").alias("student_elo_pre"), F.col("post").alias("student_elo_post"))


def _profiles(t: Tables, name: str, by_module: bool = True) -> DataFrame:
    """ELO-13 with the places a student met."""
    groups = ["user_id", "module_code"] if by_module else ["user_id"]
    unique = lambda c: F.count_distinct(c).alias
    out = t[name].groupBy(*groups).agg(
        F.count("*").alias("total_attempts"), F.min("created_at").alias("first_attempt_at"), F.max("created_at").alias("last_attempt_at"), unique("module_code")("unique_modules"), unique("objective_id")("unique_objectives"),
        unique("activity_id")("unique_activities"), F.max_by("post", "attempt_ordinal").alias("final_student_elo"),
    ).withColumn("eligible_for_replay", F.col("total_attempts") > 0)
    return _labelled(out, t["fact_attempt_core"], ["module_code"]) if by_module else out


def _renamed(source: str, **names: str) -> Callable[[Tables], DataFrame]:
    return lambda t: t[source].withColumnsRenamed({old: new for new, old in names.items()})


BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {
    "classroom_activity_summary_by_mode": _renamed("classroom_activity_summary", classrooms_observed="classrooms", attempts_total="attempts", successes_total="successes", mean_classroom_success_rate="mean_success_rate", median_classroom_success_rate="median_success_rate", weak_classroom_count="classrooms_below", success_rate="pooled_success_rate", weak_classroom_share="weak_share"),
    "agg_transition_edges": _renamed("agg_transition_edges", success_conditioned_count="destination_successes"),
    "agg_exercise_elo": lambda t: _rated(t, "exercise_elo", R.calibration_rows(t["fact_attempt_core"])),
    "agg_exercise_elo_iterative": lambda t: _rated(t, "exercise_elo_iterative", R.replay_rows(t["fact_attempt_core"])),
    "agg_activity_elo": lambda t: _labelled(_renamed("activity_elo", activity_mean_exercise_elo="mean_rating", calibrated_exercise_count="calibrated_exercises", catalog_exercise_count="exercises", calibration_coverage_ratio="coverage")(t), t["fact_attempt_core"], ["module_code", "objective_id", "activity_id"]),
    "zpdes_exercise_progression_events": lambda t: _labelled(_renamed("progression_events", destination_rank="activity_rank")(t), t["fact_attempt_core"], ["module_code", "activity_id"]),
    "work_mode_transition_paths": _renamed("work_mode_paths", transition_count_total="total_transitions"),
}
for _suffix in ("", "_batch_replay", "_iterative"):
    BUILDERS[f"student_elo_events{_suffix}"] = lambda t, s=_suffix: _events(t, f"student_elo_events{s}")
    BUILDERS[f"student_elo_profiles{_suffix}"] = lambda t, s=_suffix: _profiles(t, f"student_elo_events{s}", s != "_iterative")


def contract_report(df: DataFrame, name: str) -> DataFrame:
    """DQ-6: every column of the artifact's contract, whether it is there, and how many of its values are NULL."""
    wanted = CONTRACTS[name]
    nulls: dict[str, Column] = {c: F.count_if(F.col(c).isNull()) if c in df.columns else F.lit(None).cast("bigint") for c in wanted}
    one = df.agg(F.count("*").alias("rows"), *[n.alias(f"n{i}") for i, n in enumerate(nulls.values())])
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("present"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(wanted)])).alias("e")
    return one.select("rows", entries).select(F.lit(name).alias("table_name"), "e.column_name", "e.present", "rows", "e.nulls")


def artifact(t: Tables, name: str, exercises: DataFrame | None = None) -> DataFrame:
    """SNK-1: one stored table with exactly its contract's columns; raises if one cannot be had."""
    df = BUILDERS[name](t) if name in BUILDERS else t[name]
    if "exercise_label" in CONTRACTS[name]:
        df = _exercises(df, exercises)
    missing = [c for c in CONTRACTS[name] if c not in df.columns]
    if missing:
        raise ValueError(f"table {name} lacks {missing}")
    return df.select(*CONTRACTS[name])


def write_artifacts(t: Tables, folder: str, names: list[str] | None = None, exercises: DataFrame | None = None) -> list[str]:
    """SNK-1: the named artifacts (all by default) as Parquet."""
    wanted = [n for n in CONTRACTS if names is None or n in names]
    for name in wanted:
        artifact(t, name, exercises).write.mode("overwrite").parquet(f"{folder}/{name}")
    return wanted
