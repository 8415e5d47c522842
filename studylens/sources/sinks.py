"""Writers, table profiles and the build of derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import catalog as C, classroom as S, daily as D, paths as P, progression as G, ratings as R

Builder = Callable[["Tables"], DataFrame]


class Tables:
    """Derived tables by name, each built once; inputs of a build are taken from the same place."""

    def __init__(self, attempts: DataFrame, catalog: DataFrame | None = None, known: dict[str, DataFrame] | None = None):
        self._frames: dict[str, DataFrame] = {"fact_attempt_core": attempts, **(known or {})}
        if catalog is not None:
            self._frames["catalog"] = catalog

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = BUILDERS[name](self)
        return self._frames[name]


def _fact(build: Callable[[DataFrame], DataFrame]) -> Builder:
    return lambda t: build(t["fact_attempt_core"])


#: Builders in dependency order.
BUILDERS: dict[str, Builder] = {
    "catalog": _fact(C.derive_catalog),
    "agg_activity_daily": _fact(D.activity_daily),
    "agg_objective_daily": _fact(D.objective_daily),
    "agg_student_module_progress": _fact(D.student_module_progress),
    "agg_module_usage_daily": _fact(D.module_usage_daily),
    "agg_playlist_module_usage": _fact(D.playlist_module_usage),
    "agg_module_activity_usage": _fact(D.module_activity_usage),
    "agg_exercise_daily": _fact(D.exercise_daily),
    "agg_transition_edges": _fact(P.transition_edges),
    "work_mode_paths": _fact(P.work_mode_paths),
    "classroom_mode_profiles": _fact(D.classroom_mode_profiles),
    "classroom_activity_summary": _fact(D.classroom_activity_summary),
    "student_selection_profiles": _fact(S.selection_profiles),
    "activity_rank": lambda t: G.canonical_rank(t["catalog"]),
    "progression_events": lambda t: G.progression_events(t["fact_attempt_core"], t["activity_rank"]),
    "progression_cohorts": lambda t: G.cohorts(t["progression_events"]),
    "exercise_elo": lambda t: R.joint_ratings(R.calibration_rows(t["fact_attempt_core"])),
    "activity_elo": lambda t: R.activity_ratings(R.item_base(t["fact_attempt_core"]), t["exercise_elo"]),
    "student_elo_events": lambda t: R.sequential_replay(R.replay_rows(t["fact_attempt_core"]), t["exercise_elo"]),
    "student_elo_profiles": lambda t: R.profiles(t["student_elo_events"]),
    "exercise_elo_iterative": lambda t: R.iterative_ratings(R.replay_rows(t["fact_attempt_core"])),
    "student_elo_events_batch_replay": lambda t: R.batch_replay(R.replay_rows(t["fact_attempt_core"]), t["exercise_elo"]),
    "student_elo_profiles_batch_replay": lambda t: R.profiles(t["student_elo_events_batch_replay"]),
    "student_elo_events_iterative": lambda t: R.sequential_replay(R.replay_rows(t["fact_attempt_core"]), t["exercise_elo_iterative"], by_module=False),
    "student_elo_profiles_iterative": lambda t: R.profiles(t["student_elo_events_iterative"], by_module=False),
    "hierarchy_context_lookup": _fact(lambda fact: C.context_lookup(fact.withColumns({c: F.lit("unknown") for c in C.SOURCES if c not in fact.columns}))),
}
#: Columns that every reader of a table relies on.
CONTRACTS: dict[str, tuple[str, ...]] = {
    "catalog": ("module_id", "module_code", "objective_id", "objective_code", "activity_id", "activity_code", "exercise_id"),
    "agg_objective_daily": ("date_utc", "module_code", "objective_id", "attempts", "success_rate"),
    "agg_student_module_progress": ("date_utc", "user_id", "module_code", "attempts", "unique_activities", "success_rate", "last_attempt_at"),
    "agg_module_usage_daily": ("date_utc", "module_code", "attempts", "unique_students"),
    "agg_playlist_module_usage": ("playlist_or_module_id", "module_code", "work_mode", "attempts", "unique_students", "unique_classrooms", "success_rate"),
    "agg_module_activity_usage": ("module_code", "activity_id", "attempts", "activity_share_within_module"),
    "work_mode_paths": ("user_id", "first_work_mode", "total_transitions", "continues_after_transition_3"),
    "classroom_mode_profiles": ("mode_scope", "classroom_id", "students", "activities", "attempts"),
    "classroom_activity_summary": ("mode_scope", "activity_label", "classrooms", "mean_success_rate", "weak_share"),
    "exercise_elo": ("module_code", "objective_id", "activity_id", "exercise_id", "rating"),
    "student_elo_profiles": ("user_id", "module_code", "attempts", "final_rating"),
    "hierarchy_context_lookup": ("module_code", "objective_id", "activity_id", "exercise_id", "attempts", "unique_students"),
    "agg_activity_daily": ("date_utc", "module_code", "objective_id", "activity_id", "attempts", "success_rate", "repeat_attempt_rate", "retry_before_success_rate"),
    "agg_exercise_daily": ("date_utc", "exercise_id", "attempts", "success_rate"),
    "agg_transition_edges": ("date_utc", "from_activity_id", "to_activity_id", "transition_count"),
    "progression_events": ("user_id", "module_code", "activity_id", "prior_attempt_count"),
    "student_elo_events": ("user_id", "module_code", "attempt_ordinal", "post"),
    "activity_elo": ("activity_id", "mean_rating", "coverage"),
}


def check_contract(df: DataFrame, name: str) -> DataFrame:
    """DQ-6: raises if a declared column is missing."""
    missing = [c for c in CONTRACTS.get(name, ()) if c not in df.columns]
    if missing:
        raise ValueError(f"table {name} lacks {missing}")
    return df


def write_tables(tables: Tables, folder: str, names: list[str] | None = None) -> list[str]:
    """SNK-1: the named tables (all by default) as Parquet, in dependency order.

    A table that others read is read back from its file, so it is computed once.
    """
    spark = tables["fact_attempt_core"].sparkSession
    wanted = [n for n in BUILDERS if names is None or n in names]
    for name in wanted:
        check_contract(tables[name], name).write.mode("overwrite").parquet(f"{folder}/{name}")
        tables._frames[name] = spark.read.parquet(f"{folder}/{name}")
    return wanted


def classroom_profiles(spark: SparkSession, path: str, attempts: DataFrame) -> DataFrame:
    """CLS-4: the stored classroom profiles if the folder has them with all columns, else built from attempts."""
    wanted = D.classroom_mode_profiles(attempts)
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        return wanted
    return stored.select(*wanted.columns) if set(wanted.columns) <= set(stored.columns) else wanted


def export(df: DataFrame, path: str) -> None:
    """SNK-2: CSV, JSON or Parquet by suffix."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown suffix of {path}")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def profile(df: DataFrame, name: str) -> DataFrame:
    """SNK-3: one row: name, rows, columns and their types."""
    types = ", ".join(f"{c}:{t}" for c, t in df.dtypes)
    return df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), F.lit(types).alias("dtypes"))


def snapshot(df: DataFrame) -> DataFrame:
    """SNK-4: per column its type, nulls and their ratio, from one aggregate."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), F.col(c).alias("nulls")) for c, t in df.dtypes])).alias("x")
    return counts.select("_rows", entries).select("x.column_name", "x.dtype", F.col("_rows").alias("rows"), "x.nulls", F.when(F.col("_rows") > 0, F.col("x.nulls") / F.col("_rows")).alias("null_ratio"))


def build(spark: SparkSession, attempts: DataFrame, folder: str, names: list[str] | None = None) -> DataFrame:
    """All tables written, and the manifest of their profiles."""
    tables = Tables(attempts)
    written = write_tables(tables, folder, names)
    rows = [profile(tables[n], n) for n in written]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
