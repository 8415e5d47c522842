"""Queries of the daily and usage aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import daily as D
from ..sources import artifacts, sinks
from ..sources.attempts_view import ATTEMPTS_SQL, attempts
from .registry import register

CONTEXT_SQL = (
    ATTEMPTS_SQL
    + """, flagged AS (
  SELECT *, CAST(data_correct AS INTEGER) AS success,
    sum(coalesce(CAST(data_correct AS INTEGER), 0)) OVER (PARTITION BY user_id, exercise_id ORDER BY created_at, attempt_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
  FROM attempts
), ctx AS (
  SELECT *, CASE WHEN attempt_number = 1 THEN 1 ELSE 0 END AS first_flag, CASE WHEN attempt_number = 1 THEN success END AS first_value,
    CASE WHEN attempt_number > 1 THEN 1 ELSE 0 END AS repeat_flag,
    CASE WHEN attempt_number > 1 AND coalesce(prior, 0) = 0 THEN 1 ELSE 0 END AS retry_flag
  FROM flagged
)"""
)
_KEYS = "module_id, module_code, module_label, objective_id, objective_label, activity_id, activity_label"
_MEASURES = """count(*) AS attempts, count(DISTINCT user_id) + max(CAST(user_id IS NULL AS INTEGER)) AS unique_students,
  round(avg(success), 6) AS success_rate, round(avg(first_value), 6) AS first_attempt_success_rate,
  CAST(sum(first_flag) AS BIGINT) AS first_attempt_count, round(median(data_duration), 6) AS median_duration,
  round(avg(repeat_flag), 6) AS repeat_attempt_rate, round(avg(retry_flag), 6) AS retry_before_success_rate,
  round(avg(attempt_number), 6) AS avg_attempt_number"""
#: Unrounded daily table for queries that continue from it.
DAILY_SQL = (
    CONTEXT_SQL
    + f""", daily AS (
  SELECT date_utc, {_KEYS}, count(*) AS attempts, avg(success) AS success_rate, avg(first_value) AS first_attempt_success_rate,
    sum(first_flag) AS first_attempt_count, median(data_duration) AS median_duration, avg(repeat_flag) AS repeat_attempt_rate,
    avg(retry_flag) AS retry_before_success_rate, avg(attempt_number) AS avg_attempt_number
  FROM ctx GROUP BY ALL
)"""
)


def rounded(df):
    """Doubles at six places, so that summation order does not show."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("agg_activity_daily", CONTEXT_SQL + f" SELECT date_utc, {_KEYS}, {_MEASURES} FROM ctx GROUP BY date_utc, {_KEYS}")
def agg_activity_daily(spark, sf_dir):
    return rounded(D.activity_daily(attempts(spark, sf_dir)))


@register("agg_exercise_daily", CONTEXT_SQL + f" SELECT date_utc, {_KEYS}, exercise_id, {_MEASURES}, exercise_id AS exercise_label, 'unknown' AS exercise_type FROM ctx GROUP BY date_utc, {_KEYS}, exercise_id")
def agg_exercise_daily(spark, sf_dir):
    return rounded(D.exercise_daily(attempts(spark, sf_dir)))


@register(
    "agg_objective_daily",
    CONTEXT_SQL
    + """ SELECT date_utc, module_id, module_code, module_label, objective_id, objective_label, count(*) AS attempts,
  count(DISTINCT user_id) + max(CAST(user_id IS NULL AS INTEGER)) AS unique_students, round(avg(success), 6) AS success_rate, round(median(data_duration), 6) AS median_duration,
  round(avg(CASE WHEN attempt_number > 1 THEN 1.0::DOUBLE WHEN attempt_number <= 1 THEN 0 END), 6) AS repeat_attempt_rate
  FROM ctx GROUP BY ALL""",
)
def agg_objective_daily(spark, sf_dir):
    return rounded(D.objective_daily(attempts(spark, sf_dir)))


_CONTRACT_SQL = {
    "agg_objective_daily": """SELECT date_utc, module_id, module_code, module_label, objective_id, objective_label, count(*) AS attempts, count(DISTINCT user_id) AS unique_students, avg(success) AS success_rate, median(data_duration) AS median_duration, avg(repeat_flag) AS repeat_attempt_rate
  FROM ctx GROUP BY date_utc, module_id, module_code, module_label, objective_id, objective_label""",
    "agg_module_usage_daily": "SELECT date_utc, module_code, module_label, count(*) AS attempts, count(DISTINCT user_id) AS unique_students FROM ctx GROUP BY date_utc, module_id, module_code, module_label",
}


@register(
    "artifact_contracts",
    CONTEXT_SQL
    + "".join(f", {t} AS ({q})" for t, q in _CONTRACT_SQL.items())
    + " "
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, true AS present, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM {t}" for t in _CONTRACT_SQL for c in artifacts.CONTRACTS[t]),
)
def artifact_contracts(spark, sf_dir):
    tables = sinks.Tables(attempts(spark, sf_dir))
    first, *rest = [artifacts.contract_report(artifacts.artifact(tables, t), t) for t in _CONTRACT_SQL]
    for r in rest:
        first = first.unionByName(r)
    return first


@register(
    "agg_student_module_progress",
    CONTEXT_SQL
    + """ SELECT date_utc, user_id, module_id, module_code, module_label, count(*) AS attempts, count(DISTINCT activity_id) + max(CAST(activity_id IS NULL AS INTEGER)) AS unique_activities,
  round(avg(success), 6) AS success_rate, round(avg(attempt_number), 6) AS avg_attempt_number, max(created_at) AS last_attempt_at
  FROM ctx GROUP BY date_utc, user_id, module_id, module_code, module_label""",
)
def agg_student_module_progress(spark, sf_dir):
    return rounded(D.student_module_progress(attempts(spark, sf_dir)))


@register(
    "agg_module_usage_daily",
    ATTEMPTS_SQL
    + """ SELECT date_utc, module_id, module_code, module_label, count(*) AS attempts, count(DISTINCT user_id) AS unique_students,
  count(DISTINCT playlist_or_module_id) AS unique_playlists, count(DISTINCT activity_id) AS unique_activities FROM attempts GROUP BY ALL""",
)
def agg_module_usage_daily(spark, sf_dir):
    return D.module_usage_daily(attempts(spark, sf_dir))


PLAYLIST_SQL = (
    ATTEMPTS_SQL
    + """, playlists AS (
  SELECT playlist_or_module_id, module_id, module_code, module_label,
    CASE count(DISTINCT work_mode) WHEN 0 THEN 'unknown' WHEN 1 THEN max(work_mode) ELSE 'mixed' END AS work_mode,
    count(*) AS attempts, count(DISTINCT user_id) AS unique_students, count(DISTINCT classroom_id) AS unique_classrooms, count(DISTINCT activity_id) AS unique_activities,
    count(DISTINCT exercise_id) AS unique_exercises, avg(CAST(data_correct AS INTEGER)) AS success_rate
  FROM (SELECT *, bool_or(module_code IS NOT NULL) OVER (PARTITION BY playlist_or_module_id) AS mapped FROM attempts)
  WHERE module_code IS NOT NULL OR NOT mapped GROUP BY playlist_or_module_id, module_id, module_code, module_label
)"""
)


@register("agg_playlist_module_usage", PLAYLIST_SQL + " SELECT * REPLACE (round(success_rate, 6) AS success_rate) FROM playlists")
def agg_playlist_module_usage(spark, sf_dir):
    return rounded(D.playlist_module_usage(attempts(spark, sf_dir)))


@register("playlist_intensity", PLAYLIST_SQL + " SELECT module_code, count(*) AS playlists, round(avg(unique_activities), 6) AS mean_unique_activities FROM playlists GROUP BY module_code")
def playlist_intensity(spark, sf_dir):
    return rounded(D.playlist_intensity(D.playlist_module_usage(attempts(spark, sf_dir))))


@register("top_playlists", PLAYLIST_SQL + " SELECT * REPLACE (round(success_rate, 6) AS success_rate) FROM playlists ORDER BY attempts DESC, playlist_or_module_id NULLS FIRST, module_code NULLS FIRST LIMIT 25")
def top_playlists(spark, sf_dir):
    return rounded(D.top_playlists(D.playlist_module_usage(attempts(spark, sf_dir))))


USAGE_SQL = ATTEMPTS_SQL + f", usage AS (SELECT {_KEYS}, count(*) AS attempts, count(DISTINCT user_id) AS unique_students FROM attempts GROUP BY ALL)"


@register("agg_module_activity_usage", USAGE_SQL + " SELECT *, round(attempts / CAST(sum(attempts) OVER (PARTITION BY module_code) AS DOUBLE), 6) AS activity_share_within_module FROM usage")
def agg_module_activity_usage(spark, sf_dir):
    return rounded(D.module_activity_usage(attempts(spark, sf_dir)))


@register("top_activities", USAGE_SQL + " SELECT *, round(attempts / CAST(sum(attempts) OVER (PARTITION BY module_code) AS DOUBLE), 6) AS activity_share_within_module, coalesce(activity_label, activity_id, 'unknown') AS display_label FROM usage ORDER BY attempts DESC, module_code NULLS FIRST, activity_id NULLS FIRST LIMIT 25")
def top_activities(spark, sf_dir):
    return rounded(D.top_activities(D.module_activity_usage(attempts(spark, sf_dir))))


@register(
    "overview_kpi",
    ATTEMPTS_SQL
    + """ SELECT count(*) AS attempts, count(DISTINCT user_id) AS unique_students, count(DISTINCT exercise_id) AS unique_exercises,
  (SELECT round(avg(n), 6) FROM (SELECT count(DISTINCT exercise_id) AS n FROM attempts GROUP BY user_id)) AS exercises_per_student FROM attempts""",
)
def overview_kpi(spark, sf_dir):
    return rounded(D.overview_kpi(attempts(spark, sf_dir)))


@register(
    "work_mode_summary",
    CONTEXT_SQL
    + """, totals AS (
  SELECT work_mode, count(*) AS attempts, count(DISTINCT user_id) AS unique_students, count(DISTINCT exercise_id) AS unique_exercises,
    avg(success) AS success_rate, avg(repeat_flag) AS repeat_attempt_rate FROM ctx GROUP BY work_mode
), balanced AS (SELECT work_mode, avg(r) AS b FROM (SELECT work_mode, exercise_id, avg(success) AS r FROM ctx GROUP BY 1, 2) GROUP BY work_mode),
typical AS (SELECT work_mode, median(n) AS m FROM (SELECT work_mode, activity_id, count(*) AS n FROM ctx GROUP BY 1, 2) GROUP BY work_mode)
SELECT t.work_mode, attempts, unique_students, unique_exercises, round(success_rate, 6) AS success_rate, round(repeat_attempt_rate, 6) AS repeat_attempt_rate,
  round(b, 6) AS balanced_success_rate, round(CAST(m AS DOUBLE), 6) AS median_attempts_per_activity
FROM totals t JOIN balanced USING (work_mode) JOIN typical USING (work_mode)""",
)
def work_mode_summary(spark, sf_dir):
    return rounded(D.work_mode_summary(attempts(spark, sf_dir)))


EXPOSURE_SQL = (
    CONTEXT_SQL
    + """, exposure AS (
  SELECT user_id, module_code, count(*) AS attempts, count(DISTINCT activity_id) AS unique_activities, count(DISTINCT date_utc) AS active_days,
    coalesce(sum(coalesce(session_duration, data_duration)), 0.0) AS total_time
  FROM ctx GROUP BY user_id, module_code
)"""
)


@register(
    "exposure",
    EXPOSURE_SQL
    + """ SELECT user_id, module_code, attempts, unique_activities, active_days, round(CAST(total_time AS DOUBLE), 6) AS total_time,
  CASE WHEN attempts <= 10 THEN '<=10' WHEN attempts <= 50 THEN '11-50' ELSE '>50' END AS exposure_bucket, attempts > 10 AS effective FROM exposure""",
)
def exposure(spark, sf_dir):
    return rounded(D.exposure(attempts(spark, sf_dir)))


@register(
    "diligent_performance",
    EXPOSURE_SQL
    + """ SELECT coalesce(e.attempts >= 10 AND e.unique_activities >= 5 AND e.active_days >= 3, false) AS diligent, count(*) AS attempts, count(DISTINCT c.user_id) AS unique_students,
  round(avg(success), 6) AS success_rate, round(median(data_duration), 6) AS median_duration, round(avg(repeat_flag), 6) AS repeat_attempt_rate
  FROM ctx c LEFT JOIN exposure e ON e.user_id = c.user_id AND e.module_code = c.module_code GROUP BY 1""",
)
def diligent_performance(spark, sf_dir):
    return rounded(D.diligent_performance(attempts(spark, sf_dir)))


@register("module_domain", ATTEMPTS_SQL + " SELECT module_code, min(CASE WHEN trim(module_label) <> '' THEN module_label END) AS module_label, min(date_utc) AS min_date, max(date_utc) AS max_date FROM attempts GROUP BY module_code")
def module_domain(spark, sf_dir):
    return D.module_domain(attempts(spark, sf_dir))


def _bottleneck_sql(level: str) -> str:
    keys = ", ".join(D.LEVELS[level])
    return (
        DAILY_SQL
        + f""", scored AS (
  SELECT {keys}, CAST(sum(attempts) AS BIGINT) AS attempts, sum(success_rate * attempts) / sum(attempts) AS success_rate,
    sum(repeat_attempt_rate * attempts) / sum(attempts) AS repeat_attempt_rate, sum(retry_before_success_rate * attempts) / sum(attempts) AS retry_before_success_rate,
    sum(attempts - success_rate * attempts) / sum(attempts) AS failure_rate, sum((0.7::DOUBLE * (1 - success_rate) + 0.3::DOUBLE * retry_before_success_rate) * attempts) / sum(attempts) AS score
  FROM daily WHERE {level}_id IS NOT NULL GROUP BY {keys}
)
SELECT {keys}, attempts, round(coalesce(success_rate, 0), 6) AS success_rate, round(repeat_attempt_rate, 6) AS repeat_attempt_rate,
  round(retry_before_success_rate, 6) AS retry_before_success_rate, round(coalesce(failure_rate, 0), 6) AS failure_rate,
  round(coalesce(score, 0), 6) AS bottleneck_score, {level}_label AS display_label
FROM scored"""
    )


def _bottleneck(level: str):
    return lambda spark, sf_dir: rounded(D.bottlenecks(D.activity_daily(attempts(spark, sf_dir)), level))


for _level in D.LEVELS:
    register(f"bottleneck_{_level}", _bottleneck_sql(_level))(_bottleneck(_level))


@register(
    "classroom_mode_profiles",
    ATTEMPTS_SQL
    + """, scoped AS (SELECT *, work_mode AS mode_scope FROM attempts UNION ALL SELECT *, 'all' AS mode_scope FROM attempts)
SELECT mode_scope, classroom_id, count(DISTINCT user_id) AS students, count(DISTINCT activity_id) AS activities, count(DISTINCT objective_id) AS objectives,
  count(DISTINCT module_code) AS modules, count(*) AS attempts, min(created_at) AS first_attempt_at, max(created_at) AS last_attempt_at FROM scoped GROUP BY mode_scope, classroom_id""",
)
def classroom_mode_profiles(spark, sf_dir):
    return D.classroom_mode_profiles(attempts(spark, sf_dir))


@register(
    "classroom_activity_summary",
    CONTEXT_SQL
    + """, scoped AS (SELECT *, work_mode AS mode_scope FROM ctx UNION ALL SELECT *, 'all' AS mode_scope FROM ctx),
per_class AS (SELECT mode_scope, classroom_id, activity_label, count(*) AS n, sum(success) AS s, avg(success) AS r FROM scoped WHERE classroom_id IS NOT NULL GROUP BY ALL)
SELECT mode_scope, activity_label, count(*) AS classrooms, round(avg(r), 6) AS mean_success_rate, round(median(r), 6) AS median_success_rate,
  count(*) FILTER (WHERE r < 0.6) AS classrooms_below, CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(s) AS BIGINT) AS successes,
  round(CAST(sum(s) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS pooled_success_rate, round(CAST(count(*) FILTER (WHERE r < 0.6) AS DOUBLE) / count(*), 6) AS weak_share
FROM per_class GROUP BY mode_scope, activity_label""",
)
def classroom_activity_summary(spark, sf_dir):
    return rounded(D.classroom_activity_summary(attempts(spark, sf_dir)))


@register("min_attempts_slice", ATTEMPTS_SQL + " SELECT event_id, user_id, exercise_id, module_code FROM attempts WHERE user_id IN (SELECT user_id FROM attempts GROUP BY user_id HAVING count(*) >= 70)")
def min_attempts_slice(spark, sf_dir):
    return D.min_attempts_slice(attempts(spark, sf_dir), 70).select("event_id", "user_id", "exercise_id", "module_code")


@register("date_module_slice", ATTEMPTS_SQL + " SELECT event_id, user_id, exercise_id, date_utc FROM attempts WHERE date_utc BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND module_code = 'M1' AND objective_id = 'o1'")
def date_module_slice(spark, sf_dir):
    return D.slice_attempts(attempts(spark, sf_dir), "2024-01-05", "2024-01-20", "M1", "o1").select("event_id", "user_id", "exercise_id", "date_utc")


# the same daily tables rebuilt on a filtered population
@register("activity_daily_of_active_students", CONTEXT_SQL + f" SELECT date_utc, {_KEYS}, {_MEASURES} FROM ctx WHERE user_id IN (SELECT user_id FROM attempts GROUP BY user_id HAVING count(*) >= 70) GROUP BY date_utc, {_KEYS}")
def activity_daily_of_active_students(spark, sf_dir):
    return rounded(D.activity_daily(D.min_attempts_slice(attempts(spark, sf_dir), 70)))
