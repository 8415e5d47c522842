"""Queries of slices, label unions and composed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import daily as D, ratings as R, slices as S
from ..sources.attempts_view import ATTEMPTS_SQL, attempts
from .concentration import START_SQL, same_item
from .daily import CONTEXT_SQL, rounded
from .paths import VISITS_SQL
from .ratings import BASE_SQL, _events, _start, replay_sql
from .registry import register


@register("bottleneck_scope_objective", ATTEMPTS_SQL + " SELECT activity_id, count(*) AS attempts FROM attempts WHERE regexp_matches(module_code, '^M[0-9]+$') AND objective_id = 'o1' GROUP BY activity_id")
def bottleneck_scope_objective(spark, sf_dir):
    return S.bottleneck_scope(attempts(spark, sf_dir), "objective", "o1", "ignored").groupBy("activity_id").agg(F.count("*").alias("attempts"))


@register("playlist_scope", ATTEMPTS_SQL + " SELECT playlist_or_module_id AS value, count(*) AS attempts FROM attempts WHERE module_code = 'M1' AND work_mode = 'playlist' GROUP BY 1")
def playlist_scope(spark, sf_dir):
    return S.scope_values(S.exposure_scope(attempts(spark, sf_dir), "M1", "all").filter("work_mode = 'playlist'"), "playlist_or_module_id")


@register("classroom_scope_values", ATTEMPTS_SQL + " SELECT classroom_id AS value, count(*) AS attempts FROM attempts WHERE classroom_id IS NOT NULL GROUP BY 1")
def classroom_scope_values(spark, sf_dir):
    return S.scope_values(attempts(spark, sf_dir), "classroom_id")


@register("module_scope", ATTEMPTS_SQL + " SELECT module_code AS value, count(*) AS attempts FROM attempts WHERE module_code IS NOT NULL GROUP BY 1")
def module_scope(spark, sf_dir):
    return S.scope_values(attempts(spark, sf_dir), "module_code")


@register(
    "label_union",
    ATTEMPTS_SQL
    + """, named AS (SELECT activity_id AS id, min(activity_label) AS label FROM attempts WHERE module_code = 'M1' GROUP BY 1),
seen AS (SELECT DISTINCT activity_id AS id, 'seen ' || activity_id AS label FROM attempts)
SELECT id, coalesce(n.label, s.label) AS label FROM seen s LEFT JOIN named n USING (id)""",
)
def label_union(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    named = rows.filter("module_code = 'M1'").groupBy(F.col("activity_id").alias("id")).agg(F.min("activity_label").alias("label"))
    seen = rows.select(F.col("activity_id").alias("id"), F.concat(F.lit("seen "), "activity_id").alias("label")).distinct()
    return S.first_wins([named, seen], ["id"])


@register(
    "exercise_elo_table",
    START_SQL
    + BASE_SQL
    + """ SELECT x.module_code, x.objective_id, x.activity_id, x.exercise_id, round(rating, 6) AS exercise_elo, coalesce(calibration_attempts, 0) AS calibration_attempts, round(calibration_success_rate, 6) AS calibration_success_rate, calibration_attempts IS NOT NULL AS calibrated
FROM item_base x LEFT JOIN items i ON """
    + same_item("x", "i"),
)
def exercise_elo_table(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    table = S.rating_table(R.item_base(rows).select(*R.CONTEXT), _start(spark, sf_dir), R.calibration_rows(rows))
    return rounded(table.drop("exercise_type"))


@register(
    "path_findings",
    VISITS_SQL
    + """, routes AS (SELECT user_id, string_agg(activity_id, '>' ORDER BY step) AS path, count(*) AS n FROM visits GROUP BY user_id),
counted AS (SELECT path, count(*) AS student_count, max(n) AS path_length FROM routes GROUP BY path)
SELECT path, student_count, path_length, round(CAST(student_count AS DOUBLE) / (SELECT count(*) FROM routes), 6) AS student_share, split_part(path, '>', 1) AS entry_activity, row_number() OVER (ORDER BY student_count DESC, path) AS rank,
  CASE WHEN CAST(student_count AS DOUBLE) / (SELECT count(*) FROM routes) >= 0.5 THEN 'dominant' WHEN CAST(student_count AS DOUBLE) / (SELECT count(*) FROM routes) >= 0.2 THEN 'common' ELSE 'rare' END AS dominance FROM counted""",
)
def path_findings(spark, sf_dir):
    return rounded(S.path_findings(attempts(spark, sf_dir)))


@register("entry_activities", VISITS_SQL + " SELECT activity_id, count(*) AS student_count, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM visits WHERE step = 1), 6) AS student_share FROM visits WHERE step = 1 GROUP BY activity_id")
def entry_activities(spark, sf_dir):
    return rounded(S.entry_activities(attempts(spark, sf_dir)))


POPULATION_SQL = (
    ATTEMPTS_SQL
    + """, single AS (SELECT playlist_or_module_id FROM attempts WHERE work_mode = 'playlist' GROUP BY 1 HAVING count(DISTINCT module_code) = 1),
usable AS (SELECT * FROM attempts WHERE work_mode = 'zpdes' OR (work_mode = 'playlist' AND playlist_or_module_id IN (SELECT playlist_or_module_id FROM single))),
per_mode AS (SELECT user_id, work_mode FROM usable GROUP BY 1, 2 HAVING count(DISTINCT exercise_id) >= 3),
split AS (SELECT user_id, CASE WHEN count(*) = 2 THEN 'both_modes' ELSE 'exclusive_modes' END AS population FROM per_mode GROUP BY 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id, exercise_id ORDER BY created_at, event_id) AS k FROM usable),
turned AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(work_mode) OVER w IS DISTINCT FROM work_mode THEN 1 ELSE 0 END AS new_run FROM numbered WHERE k = 1 WINDOW w AS (PARTITION BY user_id ORDER BY created_at, exercise_id, event_id)),
in_runs AS (SELECT *, sum(new_run) OVER (PARTITION BY user_id ORDER BY created_at, exercise_id, event_id) AS run FROM turned),
runs AS (SELECT population, work_mode, user_id, run, count(*) AS n FROM in_runs JOIN split USING (user_id) GROUP BY 1, 2, 3, 4)
SELECT population, work_mode, count(DISTINCT user_id) AS students, count(*) AS runs, CAST(sum(n) AS BIGINT) AS attempts, round(avg(n), 6) AS mean_run_length FROM runs GROUP BY 1, 2"""
)


@register("population_audit", POPULATION_SQL)
def population_audit(spark, sf_dir):
    return rounded(S.population_audit(S.population_trajectories(attempts(spark, sf_dir), least=3)))


@register(
    "classroom_slice_profiles",
    CONTEXT_SQL
    + """, scoped AS (SELECT *, work_mode AS mode_scope FROM ctx WHERE module_code = 'M2' UNION ALL SELECT *, 'all' AS mode_scope FROM ctx WHERE module_code = 'M2')
SELECT mode_scope, classroom_id, count(DISTINCT user_id) AS students, count(DISTINCT activity_id) AS activities, count(DISTINCT objective_id) AS objectives,
  count(DISTINCT module_code) AS modules, count(*) AS attempts, min(created_at) AS first_attempt_at, max(created_at) AS last_attempt_at FROM scoped GROUP BY mode_scope, classroom_id""",
)
def classroom_slice_profiles(spark, sf_dir):
    return S.classroom_slice(attempts(spark, sf_dir), module_code="M2")[0]


@register("exercise_balanced_by_mode", CONTEXT_SQL + " SELECT module_code, objective_id, objective_label, activity_id, activity_label, round(avg(r), 6) AS metric_value FROM (SELECT module_code, objective_id, objective_label, activity_id, activity_label, exercise_id, avg(success) AS r FROM ctx WHERE work_mode = 'zpdes' AND objective_id IS NOT NULL AND activity_id IS NOT NULL GROUP BY ALL) GROUP BY module_code, objective_id, objective_label, activity_id, activity_label")
def exercise_balanced_by_mode(spark, sf_dir):
    from ..operators import matrix as M

    return rounded(M.cells(attempts(spark, sf_dir), "exercise_balanced_success_rate", mode="zpdes"))




SLICE_SQL = (
    ATTEMPTS_SQL
    + """, in_slice AS (
  SELECT * FROM attempts WHERE date_utc >= DATE '2024-01-10' AND module_code = 'M2'
), enough AS (SELECT user_id FROM in_slice WHERE trim(user_id) <> '' GROUP BY 1 HAVING count(*) >= 3),
renumbered AS (SELECT user_id, work_mode, row_number() OVER (PARTITION BY user_id ORDER BY created_at, work_mode, event_id) AS i FROM in_slice WHERE user_id IN (SELECT user_id FROM enough)),
turns AS (SELECT *, CASE WHEN lag(work_mode) OVER (PARTITION BY user_id ORDER BY i) = work_mode THEN 0 ELSE 1 END AS turn FROM renumbered),
stages AS (SELECT user_id, work_mode, sum(turn) OVER (PARTITION BY user_id ORDER BY i) - 1 AS stage FROM turns WHERE turn = 1)
SELECT user_id, max(work_mode) FILTER (WHERE stage = 0) AS first_work_mode, max(work_mode) FILTER (WHERE stage = 1) AS transition_1_mode, max(work_mode) FILTER (WHERE stage = 2) AS transition_2_mode,
  max(work_mode) FILTER (WHERE stage = 3) AS transition_3_mode, CAST(max(stage) AS BIGINT) AS total_transitions, max(stage) > 3 AS continues_after_transition_3 FROM stages GROUP BY user_id"""
)


@register("sliced_work_mode_paths", SLICE_SQL)
def sliced_work_mode_paths(spark, sf_dir):
    return S.sliced_work_mode_paths(attempts(spark, sf_dir), 3, start="2024-01-10", module_code="M2")


def _classmates(rows):
    """Students of classroom c3, with a blank id that is nobody's."""
    return rows.filter("classroom_id = 'c3'").select("user_id").unionByName(rows.sparkSession.createDataFrame([(" ",)], "user_id string"))


@register(
    "student_module_attempts",
    ATTEMPTS_SQL + " SELECT event_id, user_id, created_at, activity_id, exercise_id, attempt_number FROM attempts WHERE user_id IN (SELECT user_id FROM attempts WHERE classroom_id = 'c3') AND module_code = 'M1' AND work_mode = 'zpdes'",
)
def student_module_attempts(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    return S.of_students(rows, _classmates(rows), " M1 ", "zpdes").select("event_id", "user_id", "created_at", "activity_id", "exercise_id", "attempt_number")


@register("student_rating_events", replay_sql(True) + " SELECT event_id, user_id, module_code, CAST(ord AS INTEGER) AS attempt_ordinal, round(post, 6) AS post FROM replay WHERE module_code = 'M1' AND user_id IN (SELECT user_id FROM attempts WHERE classroom_id = 'c3')")
def student_rating_events(spark, sf_dir):
    return rounded(S.of_students(_events(spark, sf_dir), _classmates(attempts(spark, sf_dir)), "M1").select("event_id", "user_id", "module_code", "attempt_ordinal", "post"))


@register(
    "student_places",
    ATTEMPTS_SQL
    + """ SELECT activity_id, objective_id, module_code, min(module_label) AS module_label, min(objective_label) AS objective_label, min(activity_label) AS activity_label FROM attempts
WHERE user_id IN (SELECT user_id FROM attempts WHERE classroom_id = 'c3') AND activity_id IS NOT NULL AND objective_id IS NOT NULL AND module_code IS NOT NULL GROUP BY 1, 2, 3""",
)
def student_places(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    return S.student_places(rows, _classmates(rows))


@register(
    "exercise_daily_labelled",
    CONTEXT_SQL
    + """, named AS (SELECT exercise_id, min(activity_label) || ' / ' || exercise_id AS exercise_label, CASE WHEN min(module_code) = 'M1' THEN 'quiz' END AS exercise_type FROM attempts WHERE exercise_id LIKE '%1' GROUP BY exercise_id)
SELECT date_utc, activity_id, c.exercise_id, coalesce(any_value(exercise_label), c.exercise_id) AS exercise_label, coalesce(any_value(exercise_type), 'unknown') AS exercise_type, count(*) AS attempts, round(avg(success), 6) AS success_rate
FROM ctx c LEFT JOIN named USING (exercise_id) GROUP BY date_utc, module_id, module_code, module_label, objective_id, objective_label, activity_id, activity_label, c.exercise_id""",
)
def exercise_daily_labelled(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    label, kind = F.concat(F.min("activity_label"), F.lit(" / "), "exercise_id"), F.when(F.min("module_code") == "M1", "quiz")
    named = rows.filter("exercise_id like '%1'").groupBy("exercise_id").agg(label.alias("exercise_label"), kind.alias("exercise_type"))
    return rounded(D.exercise_daily(rows, named)).select("date_utc", "activity_id", "exercise_id", "exercise_label", "exercise_type", "attempts", "success_rate")
