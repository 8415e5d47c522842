"""Queries of concentration and of the objective x activity matrix."""

from __future__ import annotations

from ..operators import concentration as C, matrix as M, ratings as R
from ..sources.attempts_view import ATTEMPTS_SQL, attempts
from .daily import CONTEXT_SQL, rounded
from .registry import register


def entity_sql(level: str) -> str:
    id_, label = C.LEVELS[level]
    return (
        ATTEMPTS_SQL
        + f""", entity AS (
  SELECT {id_} AS id, max({label}) AS label, count(*) AS attempts, CAST(count(*) AS DOUBLE) / (SELECT count({id_}) FROM attempts) AS attempt_share, count(DISTINCT exercise_id) AS contained_exercises
  FROM attempts WHERE {id_} IS NOT NULL GROUP BY {id_}
), ranked AS (SELECT *, row_number() OVER (ORDER BY attempts DESC, id) AS rank, count(*) OVER () AS n FROM entity),
deciled AS (
  SELECT id, label, attempts, attempt_share, contained_exercises, rank,
    (SELECT min(i) FROM range(1, 11) t(i) WHERE rank <= greatest(1, ceil(n * i / 10.0::DOUBLE))) AS bucket FROM ranked
)"""
    )


def _entity(level: str):
    return lambda spark, sf_dir: rounded(C.with_deciles(C.entities(attempts(spark, sf_dir), level)))


for _level in C.LEVELS:
    register("entity_concentration" if _level == "exercise" else f"entity_concentration_{_level}", entity_sql(_level) + " SELECT * REPLACE (round(attempt_share, 6) AS attempt_share, CAST(bucket AS INTEGER) AS bucket) FROM deciled")(_entity(_level))


@register("bucket_summary", entity_sql("exercise") + " SELECT CAST(bucket AS INTEGER) AS bucket, CAST(sum(attempts) AS BIGINT) AS attempts, round(sum(attempt_share), 6) AS attempt_share, count(*) AS entity_count FROM deciled GROUP BY bucket")
def bucket_summary(spark, sf_dir):
    return rounded(C.bucket_summary(C.with_deciles(C.entities(attempts(spark, sf_dir), "exercise"))))


@register(
    "concentration_findings",
    entity_sql("exercise")
    + """, shares AS (SELECT sum(attempt_share) FILTER (WHERE bucket <= 1) AS a, sum(attempt_share) FILTER (WHERE bucket <= 2) AS b, sum(attempt_share) FILTER (WHERE bucket <= 3) AS c,
  sum(attempt_share) FILTER (WHERE bucket <= 5) AS d, median(attempts) AS m, count(*) AS entities FROM deciled)
SELECT round(a, 6) AS top_10_share, round(b, 6) AS top_20_share, round(c, 6) AS top_30_share, round(d, 6) AS top_50_share, CAST(m AS DOUBLE) AS median_attempts, entities,
  CASE WHEN a >= 0.5 THEN 'high' WHEN b >= 0.5 THEN 'moderate' ELSE 'low' END AS concentration FROM shares""",
)
def concentration_findings(spark, sf_dir):
    return rounded(C.concentration_findings(C.with_deciles(C.entities(attempts(spark, sf_dir), "exercise"))))


STUDENT_SQL = (
    ATTEMPTS_SQL
    + """, student AS (SELECT user_id, count(*) AS attempts, count(DISTINCT exercise_id) AS unique_exercises, count(DISTINCT activity_id) AS unique_activities FROM attempts WHERE user_id IS NOT NULL GROUP BY user_id),
ranked AS (SELECT *, row_number() OVER (ORDER BY attempts DESC, user_id) AS rank, count(*) OVER () AS n FROM student)"""
)


@register(
    "student_concentration",
    STUDENT_SQL
    + """ SELECT user_id, attempts, unique_exercises, unique_activities, rank, CAST((SELECT min(i) FROM range(1, 11) t(i) WHERE rank <= greatest(1, ceil(n * i / 10.0::DOUBLE))) AS INTEGER) AS bucket,
  round(CAST(attempts AS DOUBLE) / CAST(sum(attempts) OVER () AS DOUBLE), 6) AS attempt_share FROM ranked""",
)
def student_concentration(spark, sf_dir):
    return rounded(C.students(attempts(spark, sf_dir)))


WITHIN_SQL = (
    ATTEMPTS_SQL
    + """, per AS (SELECT activity_id AS id, user_id, count(*) AS attempts FROM attempts WHERE user_id IS NOT NULL AND activity_id IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY attempts DESC, user_id) AS rank, count(*) OVER (PARTITION BY id) AS n FROM per),
filled AS (SELECT id, (rank - 1) * 10 // n + 1 AS bucket, sum(attempts) AS attempts, count(*) AS students FROM ranked GROUP BY 1, 2),
total AS (SELECT id, sum(attempts) AS total, count(*) AS unique_students FROM per GROUP BY id),
within_entity AS (
  SELECT t.id, CAST(g.i AS INTEGER) AS bucket, CAST(coalesce(f.attempts, 0) AS BIGINT) AS attempts, coalesce(students, 0) AS students, unique_students,
    CAST(coalesce(f.attempts, 0) AS DOUBLE) / CAST(total AS DOUBLE) AS attempt_share
  FROM total t CROSS JOIN range(1, 11) g(i) LEFT JOIN filled f ON f.id = t.id AND f.bucket = g.i
)"""
)


@register("within_entity_concentration", WITHIN_SQL + " SELECT * REPLACE (round(attempt_share, 6) AS attempt_share) FROM within_entity")
def within_entity_concentration(spark, sf_dir):
    return rounded(C.within_entities(attempts(spark, sf_dir), "activity"))


@register("top_student_share", WITHIN_SQL + " SELECT id, round(attempt_share, 6) AS top_10_students_share, unique_students FROM within_entity WHERE bucket = 1")
def top_student_share(spark, sf_dir):
    return rounded(C.top_student_share(C.within_entities(attempts(spark, sf_dir), "activity")))


#: Smoothed start ratings, the fixed item ratings of replay oracles.
def same_item(a: str, b: str) -> str:
    """Join condition on an exercise in its context; missing levels equal each other."""
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in R.CONTEXT)


START_SQL = (
    CONTEXT_SQL
    + """, item_counts AS (SELECT module_code, objective_id, activity_id, exercise_id, count(*) AS n, CAST(sum(success) AS DOUBLE) AS s FROM ctx WHERE attempt_number = 1 AND success IS NOT NULL AND user_id IS NOT NULL AND module_code IS NOT NULL AND exercise_id IS NOT NULL GROUP BY 1, 2, 3, 4),
item_rates AS (
  SELECT *, greatest(0.01::DOUBLE, least(0.99::DOUBLE, (s + 20 * (sum(s) OVER (PARTITION BY module_code) / CAST(sum(n) OVER (PARTITION BY module_code) AS DOUBLE))) / (n + 20))) AS smoothed_rate FROM item_counts
), item_raw AS (SELECT *, 1500 - 400 * log10(smoothed_rate / (1 - smoothed_rate)) AS raw FROM item_rates),
items AS (SELECT module_code, objective_id, activity_id, exercise_id, n AS calibration_attempts, s / n AS calibration_success_rate, smoothed_rate, raw - avg(raw) OVER (PARTITION BY module_code) + 1500 AS rating FROM item_raw)"""
)

_CELL = "module_code, objective_id, objective_label, activity_id, activity_label"
_VALUES = {
    "attempts": f"SELECT {_CELL}, CAST(count(*) AS DOUBLE) AS v FROM ctx GROUP BY ALL",
    "success_rate": f"SELECT {_CELL}, avg(success) AS v FROM ctx GROUP BY {_CELL}",
    "exercise_balanced_success_rate": f"SELECT {_CELL}, avg(r) AS v FROM (SELECT {_CELL}, exercise_id, avg(success) AS r FROM ctx GROUP BY {_CELL}, exercise_id) GROUP BY {_CELL}",
    "activity_mean_exercise_elo": f"SELECT {_CELL}, avg(rating) AS v FROM (SELECT DISTINCT {_CELL}, exercise_id FROM ctx) x LEFT JOIN items i ON {same_item('x', 'i')} GROUP BY {_CELL}".replace("SELECT module_code, objective_id, objective_label, activity_id, activity_label, avg", "SELECT x.module_code, x.objective_id, objective_label, x.activity_id, activity_label, avg").replace("GROUP BY module_code, objective_id, objective_label, activity_id, activity_label", "GROUP BY x.module_code, x.objective_id, objective_label, x.activity_id, activity_label"),
    "repeat_attempt_rate": f"SELECT {_CELL}, avg(repeat_flag) AS v FROM ctx GROUP BY {_CELL}",
    "first_attempt_success_rate": f"SELECT {_CELL}, coalesce(avg(first_value), 0) AS v FROM ctx GROUP BY {_CELL}",
    "playlist_unique_exercises": f"SELECT {_CELL}, CAST(count(DISTINCT CASE WHEN work_mode = 'playlist' THEN exercise_id END) AS DOUBLE) AS v FROM ctx GROUP BY ALL",
}


def matrix_sql(metric: str) -> str:
    return (
        START_SQL
        + f""", placed AS (SELECT * FROM ctx WHERE objective_id IS NOT NULL AND activity_id IS NOT NULL), vals AS ({_VALUES[metric].replace("FROM ctx", "FROM placed")}),
objective_rows AS (SELECT module_code, objective_id, objective_label, row_number() OVER (PARTITION BY module_code ORDER BY lower(objective_label), objective_id) AS row_idx FROM (SELECT DISTINCT module_code, objective_id, objective_label FROM vals)),
cells AS (
  SELECT v.*, o.objective_label AS objective_row_label, row_idx, row_number() OVER (PARTITION BY v.module_code, v.objective_id ORDER BY lower(activity_label), activity_id) AS activity_col_idx
  FROM vals v JOIN objective_rows o ON v.module_code = o.module_code AND v.objective_id = o.objective_id
)"""
    )


def _matrix(metric: str):
    def run(spark, sf_dir):
        rows = attempts(spark, sf_dir)
        items = R.smoothed_start(R.calibration_rows(rows)) if metric == "activity_mean_exercise_elo" else None
        return rounded(M.ordered(M.cells(rows, metric, items)))

    return run


for _metric in M.METRICS:
    register(f"matrix_{_metric}", matrix_sql(_metric) + f" SELECT {_CELL}, objective_row_label, row_idx, activity_col_idx, 'A' || activity_col_idx AS activity_col_label, round(v, 6) AS metric_value FROM cells")(_matrix(_metric))


@register("exercise_drilldown", CONTEXT_SQL + " SELECT module_code, objective_id, activity_id, exercise_id, count(*) AS attempts, round(avg(success), 6) AS metric_value FROM ctx GROUP BY ALL")
def exercise_drilldown(spark, sf_dir):
    return rounded(M.drilldown(attempts(spark, sf_dir))).drop("metric_text")


@register(
    "matrix_findings",
    matrix_sql("success_rate")
    + """, halves AS (SELECT *, activity_col_idx <= max(activity_col_idx) OVER (PARTITION BY module_code, objective_id) / 2.0::DOUBLE AS early FROM cells)
SELECT module_code, objective_id, count(*) AS activities, round(avg(v), 6) AS mean_value, round(max(v) - min(v), 6) AS spread,
  arg_max(activity_id, struct_pack(a := v, b := activity_id)) AS highest_activity, arg_min(activity_id, struct_pack(a := v, b := activity_id)) AS lowest_activity,
  round(avg(CASE WHEN NOT early THEN v END) - avg(CASE WHEN early THEN v END), 6) AS late_minus_early FROM halves GROUP BY module_code, objective_id""",
)
def matrix_findings(spark, sf_dir):
    return rounded(M.matrix_findings(M.ordered(M.cells(attempts(spark, sf_dir), "success_rate"))))


def p_sql(z: str) -> str:
    """Two-sided normal p-value of a z by the power series of erf in Gamma functions."""
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN {z} = 0 THEN 1 WHEN abs({z}) > 8 THEN 0 ELSE 1 - exp(-{z} * {z} / 2) * list_sum(list_transform(range(0, 160), lambda i: exp((2 * i + 1) * ln(abs({z}) / sqrt(2)) - lgamma(i + 1.5)))) END"


def _drilldown_findings(metric: str):
    value, counts, low = {"success_rate": ("avg(success)", False, True), "repeat_attempt_rate": ("avg(repeat_flag)", False, False), "attempts": ("CAST(count(*) AS DOUBLE)", True, False)}[metric]
    sql = (
        CONTEXT_SQL
        + f""", supported AS (SELECT module_code, objective_id, activity_id, exercise_id, count(*) AS n, {value} AS v FROM ctx GROUP BY ALL HAVING count(*) >= 10 AND {value} IS NOT NULL),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY module_code, objective_id, activity_id ORDER BY v DESC, n DESC, exercise_id) AS down, count(*) OVER (PARTITION BY module_code, objective_id, activity_id) AS k,
    row_number() OVER (PARTITION BY module_code, objective_id, activity_id ORDER BY v{"" if low else " DESC"}, n DESC, exercise_id) AS shown FROM supported
), ends AS (
  SELECT module_code, objective_id, activity_id, max(k) AS exercises, max(exercise_id) FILTER (WHERE down = 1) AS highest_exercise, max(v) FILTER (WHERE down = 1) AS hv, max(n) FILTER (WHERE down = 1) AS hn,
    max(exercise_id) FILTER (WHERE down = k) AS lowest_exercise, max(v) FILTER (WHERE down = k) AS lv, max(n) FILTER (WHERE down = k) AS ln_, string_agg(exercise_id, '>' ORDER BY shown) FILTER (WHERE shown <= 5) AS ranking
  FROM ordered WHERE k >= 2 GROUP BY ALL
), tested AS (
  SELECT *, round_even(hv * hn, 0) AS hs, round_even(lv * ln_, 0) AS ls, (round_even(hv * hn, 0) + round_even(lv * ln_, 0)) / (hn + ln_) AS pooled FROM ends
), zs AS (SELECT *, {"CASE WHEN pooled > 0 AND pooled < 1 THEN (hs / hn - ls / ln_) / sqrt(pooled * (1 - pooled) * (1.0::DOUBLE / hn + 1.0::DOUBLE / ln_)) END" if low else "CAST(NULL AS DOUBLE)"} AS z FROM tested)
SELECT module_code, objective_id, activity_id, exercises, highest_exercise, round(hv, 6) AS highest_value, lowest_exercise, round(lv, 6) AS lowest_value, round(abs(hv - lv), 6) AS spread,
  CASE WHEN abs(hv - lv) >= {"20" if counts else "0.20::DOUBLE"} THEN 'uneven' ELSE 'even' END AS finding, ranking, round(z, 6) AS z, round({p_sql("z")}, 6) AS p_value FROM zs"""
    )
    register(f"drilldown_findings_{metric}", sql)(lambda spark, sf_dir: rounded(M.drilldown_findings(M.drilldown(attempts(spark, sf_dir), metric), metric)))


for _metric in ("success_rate", "repeat_attempt_rate", "attempts"):
    _drilldown_findings(_metric)
