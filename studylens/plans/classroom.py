"""Queries of classroom replay, student profiles and selection."""

from __future__ import annotations

from ..operators import classroom as C, daily as D
from ..sources.attempts_view import ATTEMPTS_SQL, attempts
from .daily import rounded
from .progression import CATALOG_SQL, derived
from .ratings import _events, replay_sql
from .registry import register

REPLAY_SQL = (
    ATTEMPTS_SQL
    + """, ordinals AS (
  SELECT classroom_id, user_id, activity_id, exercise_id, created_at, coalesce(CAST(data_correct AS INTEGER), 0) AS s,
    row_number() OVER (PARTITION BY classroom_id, user_id ORDER BY created_at, exercise_id, attempt_number, event_id) AS ordinal
  FROM attempts WHERE classroom_id IS NOT NULL AND trim(classroom_id) NOT IN ('', 'None') AND activity_id IS NOT NULL
), widths AS (SELECT classroom_id, max(ordinal) AS longest, CAST(greatest(10, ceil(max(ordinal) / 40.0::DOUBLE)) AS BIGINT) AS width FROM ordinals GROUP BY 1),
frames AS (SELECT classroom_id, longest, width, CAST(g.i AS INTEGER) AS frame, least(g.i * width, longest) AS cutoff FROM widths, range(1, 100000) g(i) WHERE (g.i - 1) * width < longest)
SELECT f.classroom_id, frame, cutoff, activity_id, user_id, count(*) AS attempts, CAST(sum(s) AS BIGINT) AS successes, round(CAST(sum(s) AS DOUBLE) / count(*), 6) AS success_rate,
  count(DISTINCT exercise_id) AS unique_exercises, max(created_at) AS last_attempt_at
FROM frames f JOIN ordinals o ON o.classroom_id = f.classroom_id AND o.ordinal <= f.cutoff GROUP BY ALL"""
)


@register("replay_frames", REPLAY_SQL)
def replay_frames(spark, sf_dir):
    return rounded(C.replay_frames(attempts(spark, sf_dir)))


for _key in ("user_id", "activity_id"):
    register(
        f"axis_order_{_key.removesuffix('_id')}",
        ATTEMPTS_SQL
        + f", firsts AS (SELECT classroom_id, {_key}, min(created_at) AS first_seen_at FROM attempts WHERE classroom_id IS NOT NULL GROUP BY 1, 2) SELECT classroom_id, {_key}, first_seen_at, row_number() OVER (PARTITION BY classroom_id ORDER BY first_seen_at, {_key}) AS position, {_key} AS label FROM firsts",
    )(lambda spark, sf_dir, key=_key: C.axis_order(attempts(spark, sf_dir), key))

PROFILE_SQL = (
    ATTEMPTS_SQL
    + """, scoped AS (SELECT *, work_mode AS mode_scope FROM attempts UNION ALL SELECT *, 'all' AS mode_scope FROM attempts),
profiles AS (SELECT mode_scope, classroom_id, count(DISTINCT user_id) AS students, count(DISTINCT activity_id) AS activities, count(DISTINCT objective_id) AS objectives,
  count(DISTINCT module_code) AS modules, count(*) AS attempts, min(created_at) AS first_attempt_at, max(created_at) AS last_attempt_at FROM scoped GROUP BY mode_scope, classroom_id)"""
)


@register(
    "default_classroom",
    PROFILE_SQL
    + """, placed AS (SELECT *, row_number() OVER (PARTITION BY mode_scope ORDER BY CASE WHEN mode_scope = 'zpdes' AND students BETWEEN 15 AND 20 AND activities BETWEEN 10 AND 49 THEN 1 ELSE 0 END DESC,
  students DESC, attempts DESC, activities DESC, classroom_id) AS r FROM profiles WHERE classroom_id IS NOT NULL) SELECT * EXCLUDE (r) FROM placed WHERE r = 1""",
)
def default_classroom(spark, sf_dir):
    return C.default_classroom(D.classroom_mode_profiles(attempts(spark, sf_dir)))


@register("classrooms_near_size", PROFILE_SQL + " SELECT *, row_number() OVER (PARTITION BY mode_scope ORDER BY activities DESC, attempts DESC, students DESC, classroom_id) AS rank FROM profiles WHERE students BETWEEN 13 AND 17")
def classrooms_near_size(spark, sf_dir):
    return C.near_size(D.classroom_mode_profiles(attempts(spark, sf_dir)), 15)


@register(
    "classroom_findings",
    ATTEMPTS_SQL
    + """, kept AS (SELECT * FROM attempts WHERE classroom_id IS NOT NULL), per_student AS (SELECT classroom_id, user_id, count(*) AS n, count(DISTINCT activity_id) AS b FROM kept GROUP BY 1, 2),
a AS (SELECT classroom_id, CAST(list_sum(list_sort(list(n), 'DESC')[1:2]) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS t, stddev_pop(n) / avg(n) AS cv, avg(b) AS mb FROM per_student GROUP BY 1),
b AS (SELECT classroom_id, count(*) FILTER (WHERE r < 0.6) AS weak_activities, count(*) AS activities FROM (SELECT classroom_id, activity_id, avg(CAST(data_correct AS INTEGER)) AS r FROM kept GROUP BY 1, 2) GROUP BY 1)
SELECT classroom_id, round(t, 6) AS top_two_share, round(cv, 6) AS attempts_cv, round(mb, 6) AS mean_breadth, weak_activities, activities FROM a JOIN b USING (classroom_id)""",
)
def classroom_findings(spark, sf_dir):
    return rounded(C.classroom_findings(attempts(spark, sf_dir)))


SELECTION_SQL = (
    ATTEMPTS_SQL
    + """, selection AS (SELECT user_id, count(*) AS attempts, min(created_at) AS first_attempt_at, max(created_at) AS last_attempt_at, count(DISTINCT module_code) AS unique_modules,
  string_agg(DISTINCT module_code, ',' ORDER BY module_code) AS modules, count(*) >= 50 AS eligible FROM attempts WHERE user_id IS NOT NULL GROUP BY user_id)"""
)


@register("selection_profiles", SELECTION_SQL + " SELECT * FROM selection")
def selection_profiles(spark, sf_dir):
    return C.selection_profiles(attempts(spark, sf_dir), 50)


@register("students_near_target", SELECTION_SQL + " SELECT * FROM selection WHERE attempts BETWEEN 54 AND 66")
def students_near_target(spark, sf_dir):
    return C.near_target(C.selection_profiles(attempts(spark, sf_dir), 50), 60)


@register(
    "representative_students",
    SELECTION_SQL
    + """, placed AS (SELECT user_id, attempts, row_number() OVER (ORDER BY attempts, user_id) AS r, count(*) OVER () AS n FROM selection)
SELECT p AS percentile, user_id, attempts FROM placed, (VALUES (0.75::DOUBLE), (0.5::DOUBLE), (0.25::DOUBLE)) v(p) WHERE r = greatest(1, ceil(n * p))""",
)
def representative_students(spark, sf_dir):
    return C.representatives(C.selection_profiles(attempts(spark, sf_dir), 50))


@register(
    "student_rollup",
    replay_sql(True)
    + """, prof AS (SELECT user_id, module_code, count(*) AS attempts, arg_max(post, ord) AS f FROM replay GROUP BY 1, 2), best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY attempts DESC, module_code) AS r FROM prof)
SELECT user_id, CAST(sum(attempts) AS BIGINT) AS attempts, count(*) AS modules, round(max(f) FILTER (WHERE r = 1), 6) AS final_rating FROM best GROUP BY user_id""",
)
def student_rollup(spark, sf_dir):
    from ..operators.ratings import profiles

    return rounded(C.student_rollup(profiles(_events(spark, sf_dir))))


SUMMARY_SQL = (
    CATALOG_SQL
    + """, objectives AS (SELECT module_code, objective_id, count(DISTINCT exercise_id) AS exercises FROM catalog GROUP BY 1, 2),
grid AS (SELECT DISTINCT user_id, module_code FROM attempts WHERE user_id IS NOT NULL), done AS (
  SELECT user_id, module_code, objective_id, count(*) AS n, count(DISTINCT exercise_id) AS e, count(*) FILTER (WHERE attempt_number = 1) AS f, avg(CAST(data_correct AS INTEGER)) AS r,
    avg(CAST(data_correct AS INTEGER)) FILTER (WHERE attempt_number = 1) AS fr FROM attempts GROUP BY 1, 2, 3
), summary AS (
  SELECT g.user_id, g.module_code, o.objective_id, o.exercises, coalesce(n, 0) AS attempts, coalesce(e, 0) AS attempted, coalesce(f, 0) AS first_attempts, r AS success_rate, fr AS first_attempt_success_rate,
    CAST(coalesce(e, 0) AS DOUBLE) / o.exercises AS coverage
  FROM grid g JOIN objectives o USING (module_code) LEFT JOIN done d ON d.user_id = g.user_id AND d.module_code = g.module_code AND d.objective_id = o.objective_id
)"""
)


def _summary(spark, sf_dir):
    return C.objective_summary(attempts(spark, sf_dir), derived(spark, sf_dir))


@register("student_objective_summary", SUMMARY_SQL + " SELECT * REPLACE (round(success_rate, 6) AS success_rate, round(first_attempt_success_rate, 6) AS first_attempt_success_rate, round(coverage, 6) AS coverage) FROM summary")
def student_objective_summary(spark, sf_dir):
    return rounded(_summary(spark, sf_dir))


@register("student_module_totals", SUMMARY_SQL + " SELECT user_id, module_code, CAST(sum(attempts) AS BIGINT) AS attempts, round(CAST(sum(attempted) AS DOUBLE) / CAST(sum(exercises) AS DOUBLE), 6) AS coverage, round(avg(success_rate), 6) AS mean_success_rate FROM summary GROUP BY user_id, module_code")
def student_module_totals(spark, sf_dir):
    return rounded(C.module_totals(_summary(spark, sf_dir)))


@register(
    "student_strengths",
    SUMMARY_SQL
    + """, middle AS (SELECT user_id, median(success_rate) AS m, median(coverage) AS c FROM summary GROUP BY 1)
SELECT user_id, module_code, objective_id, round(success_rate - m, 6) AS success_gap, round(coverage - c, 6) AS coverage_gap,
  CASE WHEN success_rate > m THEN 'strength' WHEN success_rate < m THEN 'gap' ELSE 'typical' END AS finding FROM summary JOIN middle USING (user_id)""",
)
def student_strengths(spark, sf_dir):
    return rounded(C.strengths(_summary(spark, sf_dir)))

