"""Queries of transitions, paths and trajectories."""

from __future__ import annotations

from ..operators import paths as P
from ..sources.attempts_view import ATTEMPTS_SQL, attempts
from .daily import rounded
from .registry import register

EDGES_SQL = (
    ATTEMPTS_SQL
    + """, stepped AS (
  SELECT *, lead(activity_id) OVER w AS to_activity_id, lead(activity_label) OVER w AS to_activity_label, lead(module_code) OVER w AS to_module_code,
    lead(objective_id) OVER w AS to_objective_id, lead(CAST(data_correct AS INTEGER)) OVER w AS to_success
  FROM attempts WINDOW w AS (PARTITION BY user_id ORDER BY created_at, exercise_id, attempt_number, event_id)
), edges AS (
  SELECT date_utc, activity_id AS from_activity_id, activity_label AS from_activity_label, module_code AS from_module_code, module_id AS from_module_id, module_label AS from_module_label,
    to_activity_id, to_activity_label, to_module_code, count(*) AS transition_count, CAST(coalesce(sum(to_success), 0) AS BIGINT) AS destination_successes,
    avg(CAST(objective_id = to_objective_id AS INTEGER)) AS same_objective_rate
  FROM stepped WHERE to_activity_id IS NOT NULL GROUP BY ALL
)"""
)


@register("transition_edges", EDGES_SQL + " SELECT * REPLACE (round(same_objective_rate, 6) AS same_objective_rate) FROM edges")
def transition_edges(spark, sf_dir):
    return rounded(P.transition_edges(attempts(spark, sf_dir)))


@register(
    "cross_objective_edges",
    EDGES_SQL
    + """ SELECT from_activity_id, from_activity_label, from_module_code, to_activity_id, to_activity_label, to_module_code, CAST(sum(transition_count) AS BIGINT) AS transition_count
  FROM edges WHERE same_objective_rate < 1 GROUP BY ALL ORDER BY transition_count DESC, from_activity_id, to_activity_id LIMIT 20""",
)
def cross_objective_edges(spark, sf_dir):
    return P.cross_objective_edges(P.transition_edges(attempts(spark, sf_dir)))


@register(
    "transition_share",
    EDGES_SQL
    + """ SELECT from_activity_id, to_activity_id, CAST(sum(transition_count) AS BIGINT) AS transition_count, any_value(n) AS objective_attempts,
  round(CAST(sum(transition_count) AS DOUBLE) / any_value(n), 6) AS share
FROM edges LEFT JOIN (SELECT DISTINCT activity_id, objective_id FROM attempts) a ON a.activity_id = from_activity_id
LEFT JOIN (SELECT objective_id, count(*) AS n FROM attempts GROUP BY 1) o USING (objective_id) GROUP BY from_activity_id, to_activity_id""",
)
def transition_share(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    return rounded(P.edge_share(P.transition_edges(rows), rows))


MODE_SQL = (
    ATTEMPTS_SQL
    + """, changes AS (
  SELECT user_id, work_mode, student_attempt_index AS place, lag(work_mode) OVER (PARTITION BY user_id ORDER BY student_attempt_index) AS last_mode FROM attempts
), numbered AS (
  SELECT user_id, work_mode, row_number() OVER (PARTITION BY user_id ORDER BY place) - 1 AS change FROM changes WHERE last_mode IS NULL OR last_mode <> work_mode
), mode_paths AS (
  SELECT user_id, max(work_mode) FILTER (WHERE change = 0) AS first_work_mode, max(work_mode) FILTER (WHERE change = 1) AS transition_1_mode,
    max(work_mode) FILTER (WHERE change = 2) AS transition_2_mode, max(work_mode) FILTER (WHERE change = 3) AS transition_3_mode,
    max(change) AS total_transitions, max(change) > 3 AS continues_after_transition_3
  FROM numbered GROUP BY user_id
)"""
)


@register("work_mode_paths", MODE_SQL + " SELECT * FROM mode_paths")
def work_mode_paths(spark, sf_dir):
    return P.work_mode_paths(attempts(spark, sf_dir))


@register(
    "work_mode_edges",
    MODE_SQL
    + """, steps AS (
  SELECT 0 AS stage, first_work_mode AS source, coalesce(transition_1_mode, 'no_transition') AS target FROM mode_paths
  UNION ALL SELECT 1, transition_1_mode, coalesce(transition_2_mode, 'stopped_after_1') FROM mode_paths WHERE transition_1_mode IS NOT NULL
  UNION ALL SELECT 2, transition_2_mode, coalesce(transition_3_mode, 'stopped_after_2') FROM mode_paths WHERE transition_2_mode IS NOT NULL
  UNION ALL SELECT 3, transition_3_mode, CASE WHEN continues_after_transition_3 THEN 'more_than_3' ELSE 'stopped_after_3' END FROM mode_paths WHERE transition_3_mode IS NOT NULL
) SELECT stage, source, target, count(*) AS student_count, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM mode_paths), 6) AS student_share FROM steps GROUP BY stage, source, target""",
)
def work_mode_edges(spark, sf_dir):
    return rounded(P.work_mode_edges(P.work_mode_paths(attempts(spark, sf_dir))))


@register(
    "work_mode_path_ranking",
    MODE_SQL
    + """, texts AS (SELECT concat_ws(' > ', first_work_mode, transition_1_mode, transition_2_mode, transition_3_mode, CASE WHEN continues_after_transition_3 THEN '...' END) AS path FROM mode_paths),
counted AS (SELECT path, count(*) AS student_count FROM texts GROUP BY path)
SELECT path, student_count, round(CAST(student_count AS DOUBLE) / (SELECT count(*) FROM mode_paths), 6) AS student_share, row_number() OVER (ORDER BY student_count DESC, path) AS rank FROM counted""",
)
def work_mode_path_ranking(spark, sf_dir):
    return rounded(P.work_mode_path_ranking(P.work_mode_paths(attempts(spark, sf_dir))))


VISITS_SQL = (
    ATTEMPTS_SQL
    + """, firsts AS (
  SELECT user_id, activity_id, created_at, exercise_id, attempt_number, event_id,
    row_number() OVER (PARTITION BY user_id, activity_id ORDER BY created_at, exercise_id, attempt_number, event_id) AS n
  FROM attempts WHERE trim(user_id) <> '' AND trim(activity_id) <> '' AND created_at IS NOT NULL
), visits AS (
  SELECT user_id, activity_id, created_at AS first_seen_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at, activity_id, exercise_id, attempt_number, event_id) AS step
  FROM firsts WHERE n = 1
)"""
)


@register("first_visits", VISITS_SQL + " SELECT * FROM visits")
def first_visits(spark, sf_dir):
    return P.first_visits(attempts(spark, sf_dir))


@register("first_visit_paths", VISITS_SQL + " SELECT user_id, string_agg(activity_id, '>' ORDER BY step) AS path, count(*) AS path_length FROM visits GROUP BY user_id")
def first_visit_paths(spark, sf_dir):
    return P.first_visit_paths(attempts(spark, sf_dir))


@register(
    "path_stage_edges",
    VISITS_SQL
    + """, nexts AS (SELECT *, lead(activity_id) OVER (PARTITION BY user_id ORDER BY step) AS nxt FROM visits),
counted AS (
  SELECT step, activity_id AS source, CASE WHEN nxt IS NULL THEN 'stopped_after_' || step WHEN step = 5 THEN 'more_than_5' ELSE nxt END AS target, count(*) AS student_count
  FROM nexts WHERE step BETWEEN 1 AND 5 GROUP BY ALL
) SELECT *, round(CAST(student_count AS DOUBLE) / (SELECT count(DISTINCT user_id) FROM visits), 6) AS student_share,
  round(CAST(student_count AS DOUBLE) / CAST(sum(student_count) OVER (PARTITION BY step, source) AS DOUBLE), 6) AS source_share FROM counted""",
)
def path_stage_edges(spark, sf_dir):
    return rounded(P.path_stage_edges(attempts(spark, sf_dir)))


FIRST_SQL = ATTEMPTS_SQL + ", firsts AS (SELECT * FROM attempts WHERE attempt_number = 1)"


@register("first_exposures", FIRST_SQL + " SELECT event_id, user_id, exercise_id, created_at, data_correct FROM firsts")
def first_exposures(spark, sf_dir):
    return P.first_exposures(attempts(spark, sf_dir)).select("event_id", "user_id", "exercise_id", "created_at", "data_correct")


@register(
    "progress_quantiles",
    FIRST_SQL
    + """ SELECT user_id, exercise_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, exercise_id, event_id) AS ordinal,
  round(CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at, exercise_id, event_id) AS DOUBLE) / count(*) OVER (PARTITION BY user_id), 6) AS progress_quantile FROM firsts""",
)
def progress_quantiles(spark, sf_dir):
    return rounded(P.progress_quantiles(P.first_exposures(attempts(spark, sf_dir))).select("user_id", "exercise_id", "ordinal", "progress_quantile"))


@register(
    "retry_exposures",
    ATTEMPTS_SQL
    + """, lagged AS (SELECT *, lag(attempt_number) OVER (PARTITION BY user_id, exercise_id ORDER BY created_at, event_id) AS last_number FROM attempts),
marked AS (SELECT *, CASE WHEN last_number IS NULL OR attempt_number <= last_number THEN 1 ELSE 0 END AS new_exposure FROM lagged)
SELECT event_id, attempt_number, new_exposure, CAST(sum(new_exposure) OVER (PARTITION BY user_id, exercise_id ORDER BY created_at, event_id) AS BIGINT) AS exposure_index FROM marked""",
)
def retry_exposures(spark, sf_dir):
    return P.retry_exposures(attempts(spark, sf_dir)).select("event_id", "attempt_number", "new_exposure", "exposure_index")


def runs_sql(scope: str) -> str:
    module = " OR lag(module_code) OVER w IS DISTINCT FROM module_code" if scope == "module" else ""
    return (
        FIRST_SQL
        + f""", turned AS (
  SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(work_mode) OVER w IS DISTINCT FROM work_mode{module} THEN 1 ELSE 0 END AS new_run
  FROM firsts WINDOW w AS (PARTITION BY user_id ORDER BY created_at, exercise_id, event_id)
), in_runs AS (SELECT *, CAST(sum(new_run) OVER (PARTITION BY user_id ORDER BY created_at, exercise_id, event_id) AS BIGINT) AS run FROM turned),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY created_at, exercise_id, event_id) - 1 AS position, count(*) OVER (PARTITION BY user_id, run) AS run_length FROM in_runs
)"""
    )


def _trajectory(scope: str):
    return lambda spark, sf_dir: P.trajectories(attempts(spark, sf_dir), scope).select("event_id", "user_id", "work_mode", "run", "position", "run_length")


for _name, _scope in (("trajectory_activity", "student"), ("trajectory_module", "module")):
    register(_name, runs_sql(_scope) + " SELECT event_id, user_id, work_mode, run, position, run_length FROM runs")(_trajectory(_scope))


@register(
    "segment_progress",
    runs_sql("student")
    + """ SELECT user_id, run, work_mode, max(run_length) AS run_length,
  round(100 * (avg(CASE WHEN position >= run_length - run_length // 2 THEN CAST(data_correct AS INTEGER) END) - avg(CASE WHEN position < run_length // 2 THEN CAST(data_correct AS INTEGER) END)), 6) AS progress
FROM runs WHERE run_length >= 2 GROUP BY user_id, run, work_mode""",
)
def segment_progress(spark, sf_dir):
    return rounded(P.segment_progress(P.trajectories(attempts(spark, sf_dir))))


@register("individual_series", ATTEMPTS_SQL + " SELECT user_id, activity_id, count(*) AS attempts, round(avg(CAST(data_correct AS INTEGER)), 6) AS success_rate, max(student_attempt_index) AS last_ordinal FROM attempts WHERE student_attempt_index <= 40 GROUP BY user_id, activity_id")
def individual_series(spark, sf_dir):
    return rounded(P.individual_series(attempts(spark, sf_dir), 40))


@register(
    "last_moves",
    ATTEMPTS_SQL
    + """, moves AS (
  SELECT user_id, student_attempt_index, activity_id AS to_activity_id, lag(activity_id) OVER (PARTITION BY user_id ORDER BY student_attempt_index) AS from_activity_id
  FROM attempts WHERE student_attempt_index <= 40
), ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY student_attempt_index DESC) AS recency FROM moves WHERE from_activity_id <> to_activity_id)
SELECT user_id, recency, student_attempt_index, from_activity_id, to_activity_id FROM ranked WHERE recency <= 3""",
)
def last_moves(spark, sf_dir):
    return P.last_moves(attempts(spark, sf_dir), 40)
