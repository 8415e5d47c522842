"""Queries of progression, the derived catalog and hierarchy resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import stored
from ..operators import catalog as C, daily as D, progression as P
from ..sources.attempts_view import ATTEMPTS_SQL, attempts
from .daily import DAILY_SQL, rounded
from .registry import register

#: Hierarchy from attempts with orders and codes by first time seen.
CATALOG_SQL = (
    ATTEMPTS_SQL
    + """, places AS (
  SELECT module_id, module_code, module_label, objective_id, objective_label, activity_id, activity_label, exercise_id, min(created_at) AS first_at
  FROM attempts WHERE exercise_id IS NOT NULL AND activity_id IS NOT NULL AND objective_id IS NOT NULL GROUP BY ALL
), seen AS (
  SELECT *, min(first_at) OVER (PARTITION BY module_id, objective_id) AS o_at, min(first_at) OVER (PARTITION BY module_id, objective_id, activity_id) AS a_at FROM places
), ordered AS (
  SELECT *, dense_rank() OVER (PARTITION BY module_id ORDER BY o_at, objective_id) AS objective_order,
    dense_rank() OVER (PARTITION BY module_id, objective_id ORDER BY a_at, activity_id) AS activity_order FROM seen
), catalog AS (
  SELECT module_id, module_code, module_label, objective_id, objective_label, activity_id, activity_label, exercise_id, objective_order, activity_order,
    module_code || 'O' || lpad(CAST(objective_order AS VARCHAR), 2, '0') AS objective_code,
    module_code || 'O' || lpad(CAST(objective_order AS VARCHAR), 2, '0') || 'A' || lpad(CAST(activity_order AS VARCHAR), 2, '0') AS activity_code
  FROM ordered
), ranks AS (
  SELECT module_code, activity_id, row_number() OVER (PARTITION BY module_code ORDER BY min(objective_order), min(activity_order), activity_id) - 1 AS activity_rank
  FROM catalog GROUP BY module_code, activity_id
)"""
)


def derived(spark, sf_dir):
    return C.derive_catalog(attempts(spark, sf_dir))


@register("derived_catalog", CATALOG_SQL + " SELECT * FROM catalog")
def derived_catalog(spark, sf_dir):
    return derived(spark, sf_dir)


@register("canonical_activity_rank", CATALOG_SQL + " SELECT * FROM ranks")
def canonical_activity_rank(spark, sf_dir):
    return P.canonical_rank(derived(spark, sf_dir))


for _level, _id, _label in (("exercise", "exercise_id", "exercise_id"), ("activity", "activity_id", "activity_label"), ("objective", "objective_id", "objective_label"), ("module", "module_code", "module_label")):
    register(f"catalog_totals_{_level}", CATALOG_SQL + f" SELECT {_id} AS id, max({_label}) AS label, count(DISTINCT exercise_id) AS exercises FROM catalog GROUP BY {_id}")(lambda spark, sf_dir, level=_level: C.catalog_totals(derived(spark, sf_dir), level))

EVENTS_SQL = (
    CATALOG_SQL
    + """, ready AS (SELECT a.*, activity_rank, CAST(data_correct AS DOUBLE) AS y FROM attempts a JOIN ranks USING (module_code, activity_id) WHERE data_correct IS NOT NULL AND user_id IS NOT NULL AND exercise_id IS NOT NULL),
picked AS (SELECT *, row_number() OVER (PARTITION BY user_id, module_code, work_mode, exercise_id ORDER BY created_at, event_id) AS n FROM ready),
progress AS (
  SELECT e.user_id, e.module_code, e.work_mode, e.activity_id, e.activity_rank, e.exercise_id, e.date_utc, e.created_at, e.event_id, e.y AS exercise_first_attempt_outcome,
    count(p.event_id) AS prior_attempt_count, count(*) FILTER (WHERE p.activity_rank < e.activity_rank) AS prior_before_activity_attempt_count,
    count(*) FILTER (WHERE p.activity_id = e.activity_id) AS prior_same_activity_attempt_count
  FROM picked e LEFT JOIN ready p ON p.user_id = e.user_id AND p.module_code = e.module_code AND p.work_mode = e.work_mode AND p.created_at < e.created_at
  WHERE e.n = 1 GROUP BY ALL
), progression AS (SELECT *, greatest(0, prior_attempt_count - prior_before_activity_attempt_count - prior_same_activity_attempt_count) AS prior_later_activity_attempt_count FROM progress)"""
)


def _events(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    return P.progression_events(rows, P.canonical_rank(C.derive_catalog(rows)))


@register("progression_events", EVENTS_SQL + " SELECT * FROM progression")
def progression_events(spark, sf_dir):
    return _events(spark, sf_dir)


def _cohort_part(name: str, condition: str) -> str:
    y = f"exercise_first_attempt_outcome) FILTER (WHERE {condition}"
    return f"""count(*) FILTER (WHERE {condition}) AS {name}_event_count, count(DISTINCT user_id) FILTER (WHERE {condition}) AS {name}_unique_students,
    avg({y}) AS {name}_success_rate, CAST(coalesce(sum(prior_attempt_count) FILTER (WHERE {condition}), 0) AS BIGINT) AS {name}_previous_attempts,
    CAST(coalesce(sum({y}), 0) AS BIGINT) AS {name}_success_count"""


COHORT_SQL = (
    EVENTS_SQL
    + ", cohorts AS (SELECT module_code, work_mode, activity_id, "
    + ", ".join(
        [
            _cohort_part("before", "prior_same_activity_attempt_count = 0 AND prior_before_activity_attempt_count > 0 AND prior_later_activity_attempt_count = 0"),
            _cohort_part("after", "prior_later_activity_attempt_count >= 1"),
            _cohort_part("in_activity", "prior_same_activity_attempt_count > 0 AND prior_later_activity_attempt_count < 1"),
        ]
    )
    + " FROM progression GROUP BY module_code, work_mode, activity_id)"
)


@register("progression_cohorts", COHORT_SQL + " SELECT * REPLACE (round(before_success_rate, 6) AS before_success_rate, round(after_success_rate, 6) AS after_success_rate, round(in_activity_success_rate, 6) AS in_activity_success_rate) FROM cohorts")
def progression_cohorts(spark, sf_dir):
    return rounded(P.cohorts(_events(spark, sf_dir)))


@register(
    "cohort_findings",
    COHORT_SQL
    + """, scored AS (
  SELECT module_code, work_mode, activity_id, after_success_rate - before_success_rate AS gap, before_event_count * (1 - before_success_rate) AS failure_impact,
    (after_success_rate - before_success_rate) / nullif(sqrt((after_success_count + before_success_count) / CAST(after_event_count + before_event_count AS DOUBLE)
      * (1 - (after_success_count + before_success_count) / CAST(after_event_count + before_event_count AS DOUBLE)) * (1 / CAST(after_event_count AS DOUBLE) + 1 / CAST(before_event_count AS DOUBLE))), 0) AS z
  FROM cohorts WHERE after_event_count >= 20 AND before_event_count >= 20 AND after_unique_students >= 5 AND before_unique_students >= 5
) SELECT module_code, work_mode, activity_id, round(gap, 6) AS gap, round(failure_impact, 6) AS failure_impact,
  CASE WHEN gap >= 0.05 THEN 'recovery' WHEN gap <= -0.05 THEN 'after_friction' ELSE 'stable' END AS finding, round(z, 6) AS z,
  row_number() OVER (PARTITION BY module_code, work_mode ORDER BY round(failure_impact, 6) DESC, activity_id) AS rank FROM scored""",
)
def cohort_findings(spark, sf_dir):
    return rounded(P.cohort_findings(P.cohorts(_events(spark, sf_dir))).drop("p_value"))


_MODES = ("zpdes", "playlist", "adaptive-test", "initial-test")


@register(
    "mode_first_attempt_wide",
    ATTEMPTS_SQL
    + " SELECT module_code, activity_id, "
    + ", ".join(f"round(avg(CAST(data_correct AS INTEGER)) FILTER (WHERE work_mode = '{m}'), 6) AS {m.replace('-', '_')}_success_rate, count(*) FILTER (WHERE work_mode = '{m}') AS {m.replace('-', '_')}_attempts" for m in _MODES)
    + " FROM attempts WHERE attempt_number = 1 GROUP BY module_code, activity_id",
)
def mode_first_attempt_wide(spark, sf_dir):
    return rounded(P.mode_first_attempts(attempts(spark, sf_dir)))


def _overlay(level: str) -> str:
    return f"""SELECT module_code, {level}_id AS node_id, '{level}' AS node_type, CAST(sum(attempts) AS BIGINT) AS attempts, round(sum(success_rate * attempts) / sum(attempts), 6) AS success_rate,
  round(sum(repeat_attempt_rate * attempts) / sum(attempts), 6) AS repeat_attempt_rate FROM daily GROUP BY module_code, {level}_id"""


@register("graph_overlay", DAILY_SQL + " " + _overlay("activity") + " UNION ALL " + _overlay("objective"))
def graph_overlay(spark, sf_dir):
    return rounded(P.overlay(D.activity_daily(attempts(spark, sf_dir))))


def raw_attempts(spark, sf_dir):
    """Attempts with placeholders and gaps in their ids, as raw logs have them."""
    n = F.col("event_id") % 6
    out = attempts(spark, sf_dir).drop("module_id", "module_code", "module_label", "objective_label", "activity_label")
    return out.withColumns(
        {
            "playlist_or_module_id": F.when(n == 1, "None").when(n == 5, " null ").otherwise(F.col("playlist_or_module_id")),
            "objective_id": F.when(n.isin(2, 5), "None").otherwise(F.col("objective_id")),
            "activity_id": F.when(n.isin(3, 5), "").when(n == 4, "unknown-activity").otherwise(F.col("activity_id")),
        }
    )


def _codes(catalog):
    pick = lambda i, c: catalog.select(F.col(i).alias("id"), F.col(c).alias("code")).distinct()
    return pick("objective_id", "objective_code").unionByName(pick("activity_id", "activity_code"))


FACT_SQL = (
    CATALOG_SQL
    + """, raw_attempts AS (
  SELECT event_id, user_id, exercise_id, CASE event_id % 6 WHEN 1 THEN NULL WHEN 5 THEN NULL ELSE playlist_or_module_id END AS pid,
    CASE WHEN event_id % 6 IN (2, 5) THEN NULL ELSE objective_id END AS oid,
    CASE WHEN event_id % 6 IN (3, 5) THEN NULL WHEN event_id % 6 = 4 THEN 'unknown-activity' ELSE activity_id END AS aid FROM attempts
), objective_codes AS (SELECT DISTINCT objective_id, objective_code, objective_label FROM catalog),
activity_codes AS (SELECT DISTINCT activity_id, activity_code, activity_label FROM catalog),
modules AS (SELECT DISTINCT module_id, module_code, module_label FROM catalog),
fallback AS (SELECT *, row_number() OVER (PARTITION BY exercise_id ORDER BY module_code, objective_code, activity_code) AS r FROM catalog),
linked AS (
  SELECT r.*, o.objective_code AS o_code, o.objective_label AS d_objective_label, a.activity_code AS a_code, a.activity_label AS d_activity_label, m.module_id AS d_module_id, m.module_code AS d_module_code, m.module_label AS d_module_label,
    regexp_extract(coalesce(o.objective_code, a.activity_code), '^(M[0-9]+)', 1) AS c_module,
    nullif(coalesce(nullif(regexp_extract(a.activity_code, '^(M[0-9]+O[0-9]+)', 1), ''), o.objective_code), '') AS c_objective, a.activity_code AS c_activity,
    f.module_id AS e_module_id, f.module_code AS e_module_code, f.module_label AS e_module_label, f.objective_id AS e_objective_id, f.objective_label AS e_objective_label, f.activity_id AS e_activity_id, f.activity_label AS e_activity_label
  FROM raw_attempts r LEFT JOIN objective_codes o ON o.objective_id = r.oid LEFT JOIN activity_codes a ON a.activity_id = r.aid
  LEFT JOIN modules m ON m.module_id = r.pid LEFT JOIN fallback f ON f.exercise_id = r.exercise_id AND f.r = 1
), fact AS (
  SELECT l.event_id, l.user_id, l.exercise_id, l.pid AS playlist_or_module_id,
    coalesce(d_module_id, cm.module_id, CASE WHEN oid IS NULL AND aid IS NULL THEN e_module_id END) AS module_id,
    coalesce(d_module_code, cm.module_code, CASE WHEN oid IS NULL AND aid IS NULL THEN e_module_code END) AS module_code,
    coalesce(d_module_label, cm.module_label, CASE WHEN oid IS NULL AND aid IS NULL THEN e_module_label END) AS module_label,
    coalesce(oid, co.objective_id, e_objective_id) AS objective_id, CASE WHEN oid IS NOT NULL THEN d_objective_label ELSE coalesce(co.objective_label, e_objective_label) END AS objective_label,
    coalesce(aid, ca.activity_id, e_activity_id) AS activity_id, CASE WHEN aid IS NOT NULL THEN d_activity_label ELSE coalesce(ca.activity_label, e_activity_label) END AS activity_label,
    CASE WHEN d_module_id IS NOT NULL THEN 'direct' WHEN cm.module_id IS NOT NULL THEN 'context' WHEN oid IS NULL AND aid IS NULL AND e_module_id IS NOT NULL THEN 'exercise' ELSE 'missing' END AS resolution_source_module,
    CASE WHEN oid IS NOT NULL AND d_objective_label IS NOT NULL THEN 'direct' WHEN oid IS NOT NULL THEN 'raw_id' WHEN co.objective_id IS NOT NULL THEN 'context' WHEN e_objective_id IS NOT NULL THEN 'exercise' ELSE 'missing' END AS resolution_source_objective,
    CASE WHEN aid IS NOT NULL AND d_activity_label IS NOT NULL THEN 'direct' WHEN aid IS NOT NULL THEN 'raw_id' WHEN ca.activity_id IS NOT NULL THEN 'context' WHEN e_activity_id IS NOT NULL THEN 'exercise' ELSE 'missing' END AS resolution_source_activity
  FROM linked l LEFT JOIN modules cm ON cm.module_code = l.c_module LEFT JOIN objective_codes co ON co.objective_code = l.c_objective LEFT JOIN activity_codes ca ON ca.activity_code = l.c_activity
)"""
)
_FACT = ["event_id", "user_id", "exercise_id", "playlist_or_module_id", "module_id", "module_code", "module_label", "objective_id", "objective_label", "activity_id", "activity_label", "resolution_source_module", "resolution_source_objective", "resolution_source_activity"]


def fact(spark, sf_dir):
    catalog = stored(derived(spark, sf_dir), "catalog")  # read by every dimension of the resolution
    return C.resolve(raw_attempts(spark, sf_dir), catalog, _codes(catalog))


@register("fact_attempt_core", FACT_SQL + " SELECT " + ", ".join(_FACT) + " FROM fact")
def fact_attempt_core(spark, sf_dir):
    return fact(spark, sf_dir).select(*_FACT)


@register("hierarchy_context_lookup", FACT_SQL + f" SELECT {', '.join(c for c in _FACT if c not in ('event_id', 'user_id'))}, count(*) AS attempts, count(DISTINCT user_id) AS unique_students FROM fact GROUP BY ALL")
def hierarchy_context_lookup(spark, sf_dir):
    return C.context_lookup(fact(spark, sf_dir))


@register("resolution_report", FACT_SQL + " " + " UNION ALL ".join(f"SELECT '{x}' AS level, resolution_source_{x} AS source, count(*) AS attempts, count(DISTINCT exercise_id) AS exercises FROM fact GROUP BY 2" for x in ("module", "objective", "activity")))
def resolution_report(spark, sf_dir):
    return C.resolution_report(fact(spark, sf_dir))


@register("multi_context_exercises", FACT_SQL + " SELECT exercise_id, count(DISTINCT row(module_id, objective_id, activity_id)) AS contexts FROM fact GROUP BY exercise_id HAVING count(DISTINCT row(module_id, objective_id, activity_id)) > 1")
def multi_context_exercises(spark, sf_dir):
    return C.multi_context_exercises(fact(spark, sf_dir))
