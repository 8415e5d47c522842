"""Queries of ranked evidence and modelling inputs."""

from __future__ import annotations

from ..functions.columns import success
from ..operators import daily as D, evidence as E, paths as P
from ..sources.attempts_view import ATTEMPTS_SQL, attempts
from .concentration import START_SQL, p_sql, same_item
from .daily import CONTEXT_SQL, DAILY_SQL, rounded
from .paths import EDGES_SQL, runs_sql
from .ratings import _events, _start, replay_sql
from .registry import register


@register(
    "bottleneck_evidence",
    DAILY_SQL
    + """, scored AS (
  SELECT activity_id, CAST(sum(attempts) AS BIGINT) AS attempts, coalesce(sum((1 - success_rate) * attempts), 0) / sum(attempts) AS f, sum(retry_before_success_rate * attempts) / sum(attempts) AS q,
    coalesce(sum((0.7::DOUBLE * (1 - success_rate) + 0.3::DOUBLE * retry_before_success_rate) * attempts), 0) / sum(attempts) AS score FROM daily WHERE activity_id IS NOT NULL GROUP BY 1
), impacts AS (SELECT * FROM scored), ranked AS (SELECT *, score * attempts AS impact, row_number() OVER (ORDER BY round(score * attempts, 6) DESC, activity_id) AS rank FROM impacts)
SELECT activity_id, attempts, round(score, 6) AS bottleneck_score, round(impact, 6) AS impact, CASE WHEN f - q > 0.1 THEN 'failure' WHEN f - q < -0.1 THEN 'retry' ELSE 'mixed' END AS driver, rank,
  round(sum(CASE WHEN rank <= 3 THEN impact ELSE 0 END) OVER () / sum(impact) OVER (), 6) AS top_3_share FROM ranked""",
)
def bottleneck_evidence(spark, sf_dir):
    return rounded(E.bottleneck_evidence(D.bottlenecks(D.activity_daily(attempts(spark, sf_dir)))))


@register(
    "transition_evidence",
    EDGES_SQL
    + """, pairs AS (SELECT from_activity_id, to_activity_id, CAST(sum(transition_count) AS BIGINT) AS n, CAST(sum(destination_successes) AS BIGINT) AS s FROM edges GROUP BY 1, 2)
SELECT from_activity_id, to_activity_id, n, s, round(CAST(s AS DOUBLE) / n, 6) AS destination_success, n - s AS fragility, row_number() OVER (ORDER BY n - s DESC, from_activity_id NULLS FIRST, to_activity_id) AS rank,
  round(CAST(s AS DOUBLE) / n - CAST(sum(s) OVER () - s AS DOUBLE) / CAST(sum(n) OVER () - n AS DOUBLE), 6) AS gap_to_rest FROM pairs""",
)
def transition_evidence(spark, sf_dir):
    return rounded(E.transition_evidence(P.transition_edges(attempts(spark, sf_dir))))


@register(
    "work_mode_evidence",
    CONTEXT_SQL
    + """, t AS (SELECT work_mode, count(*) AS n, avg(success) AS r FROM ctx GROUP BY 1), b AS (SELECT work_mode, avg(r) AS b FROM (SELECT work_mode, exercise_id, avg(success) AS r FROM ctx GROUP BY 1, 2) GROUP BY 1)
SELECT work_mode, round(CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE), 6) AS attempt_share, round(r - b, 6) AS balance_gap, row_number() OVER (ORDER BY n DESC, work_mode) AS rank FROM t JOIN b USING (work_mode)""",
)
def work_mode_evidence(spark, sf_dir):
    return rounded(E.work_mode_evidence(D.work_mode_summary(attempts(spark, sf_dir))))


@register("movement_mean_test", replay_sql(True) + " SELECT activity_id, count(*) AS n, round(avg(post - pre), 6) AS mean, round(stddev_samp(post - pre), 6) AS sd, round(avg(post - pre) / (stddev_samp(post - pre) / sqrt(count(*))), 6) AS z FROM replay GROUP BY activity_id")
def movement_mean_test(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = _events(spark, sf_dir).withColumn("delta", F.col("post") - F.col("pre"))
    return rounded(E.mean_test(rows, "activity_id", "delta").drop("p_value"))


@register(
    "module_usage_by_mode",
    ATTEMPTS_SQL
    + """, per AS (SELECT module_code, work_mode, user_id, count(*) AS k FROM attempts GROUP BY 1, 2, 3), used AS (SELECT module_code, work_mode, count(*) AS students, avg(k) AS mean, stddev_samp(k) AS sd FROM per GROUP BY 1, 2)
SELECT module_code, work_mode, students, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(students), 6) AS se, round(mean - 1.96::DOUBLE * sd / sqrt(students), 6) AS low, round(mean + 1.96::DOUBLE * sd / sqrt(students), 6) AS high,
  row_number() OVER (PARTITION BY work_mode ORDER BY students DESC, module_code) AS rank FROM used""",
)
def module_usage_by_mode(spark, sf_dir):
    return rounded(E.module_usage_by_mode(attempts(spark, sf_dir)))


@register(
    "population_split",
    ATTEMPTS_SQL
    + """, per AS (SELECT user_id, work_mode, count(DISTINCT exercise_id) AS e FROM attempts WHERE work_mode IN ('zpdes', 'playlist') GROUP BY 1, 2 HAVING count(DISTINCT exercise_id) >= 3)
SELECT user_id, CASE WHEN count(*) = 2 THEN 'both_modes' ELSE 'exclusive_modes' END AS population, CAST(sum(e) AS BIGINT) AS exercises FROM per GROUP BY user_id""",
)
def population_split(spark, sf_dir):
    return E.population_split(attempts(spark, sf_dir), least=3)


@register(
    "single_module_playlists",
    ATTEMPTS_SQL
    + """, single AS (SELECT playlist_or_module_id FROM attempts WHERE work_mode = 'playlist' GROUP BY 1 HAVING count(DISTINCT module_code) = 1)
SELECT event_id, user_id, work_mode, playlist_or_module_id FROM attempts WHERE work_mode <> 'playlist' OR playlist_or_module_id IN (SELECT playlist_or_module_id FROM single)""",
)
def single_module_playlists(spark, sf_dir):
    return E.single_module_playlists(attempts(spark, sf_dir)).select("event_id", "user_id", "work_mode", "playlist_or_module_id")


@register("empirical_curve", START_SQL + runs_sql("student").split("FROM coded\n)", 1)[1] + " SELECT work_mode, position, count(*) AS attempts, round(avg(CAST(data_correct AS INTEGER)), 6) AS success_rate, round(avg(coalesce(rating, m)), 6) AS mean_item_rating, round(CAST(count(coalesce(rating, m)) AS DOUBLE) / count(*), 6) AS rating_coverage FROM runs x LEFT JOIN items i ON " + same_item("x", "i") + " LEFT JOIN (SELECT exercise_id AS e, avg(rating) AS m FROM items GROUP BY 1) f ON f.e = x.exercise_id GROUP BY work_mode, position")
def empirical_curve(spark, sf_dir):
    return rounded(P.empirical_curve(P.trajectories(attempts(spark, sf_dir)), _start(spark, sf_dir)))


@register(
    "model_design",
    runs_sql("student")
    + """ SELECT user_id, classroom_id, module_code, 1.0::DOUBLE AS intercept, CAST(work_mode = 'zpdes' AS DOUBLE) AS zpdes, CAST(position AS DOUBLE) AS position, CAST(work_mode = 'zpdes' AS DOUBLE) * position AS interaction, CAST(data_correct AS DOUBLE) AS y,
  dense_rank() OVER (ORDER BY user_id NULLS FIRST) AS student_code, dense_rank() OVER (ORDER BY classroom_id NULLS FIRST, user_id NULLS FIRST) AS classroom_code FROM runs WHERE work_mode IN ('zpdes', 'playlist')""",
)
def model_design(spark, sf_dir):
    return E.design(P.trajectories(attempts(spark, sf_dir)))


@register("clustered_ols")
def clustered_ols(spark, sf_dir):
    rows = E.design(P.trajectories(attempts(spark, sf_dir))).filter("classroom_id is not null")
    return rounded(E.clustered_ols(rows, "y", ["zpdes", "position", "interaction"], "module_code", "classroom_id"))


@register(
    "adjusted_mode_means",
    ATTEMPTS_SQL
    + """, used AS (
  SELECT CAST(data_correct AS DOUBLE) AS y, CASE WHEN work_mode = 'zpdes' THEN 1.0::DOUBLE ELSE 0 END AS x, module_code AS g, classroom_id AS c FROM attempts
  WHERE work_mode IN ('zpdes', 'playlist') AND data_correct IS NOT NULL AND classroom_id IS NOT NULL
), centred AS (SELECT *, x - avg(x) OVER (PARTITION BY g) AS dx, y - avg(y) OVER (PARTITION BY g) AS dy FROM used),
whole AS (SELECT sum(dx * dy) / sum(dx * dx) AS b, 1 / sum(dx * dx) AS inv, avg(x) AS mx, avg(y) AS my, count(*) AS n, count(DISTINCT c) AS k, count(DISTINCT coalesce(g, '')) AS m FROM centred),
scores AS (SELECT c, sum(dx * (dy - b * dx)) AS s, sum(dy - b * dx) AS u FROM centred, whole GROUP BY c),
spread AS (SELECT sum((inv * s) ** 2) AS v0, sum((u / n + (1 - mx) * inv * s) ** 2) AS v1, sum((u / n - mx * inv * s) ** 2) AS v2 FROM scores, whole),
fitted AS (SELECT *, CAST(k AS DOUBLE) / (k - 1) * (n - 1) / (n - 1 - m) AS f, b / sqrt(v0 * CAST(k AS DOUBLE) / (k - 1) * (n - 1) / (n - 1 - m)) AS z FROM whole, spread)
SELECT round(b, 6) AS estimate, round(sqrt(v0 * f), 6) AS std_error, round(my + b * (1 - mx), 6) AS first_mean, round(sqrt(v1 * f), 6) AS first_error, round(my - b * mx, 6) AS second_mean, round(sqrt(v2 * f), 6) AS second_error,
  n, k AS clusters, m AS groups, round(z, 6) AS z, """
    + f"round({p_sql('z')}, 6) AS p_value, round(b - 1.959963984540054::DOUBLE * sqrt(v0 * f), 6) AS ci_low, round(b + 1.959963984540054::DOUBLE * sqrt(v0 * f), 6) AS ci_high FROM fitted",
)
def adjusted_mode_means(spark, sf_dir):
    rows = attempts(spark, sf_dir).filter("classroom_id is not null").withColumn("y", success())
    return rounded(E.adjusted_means(rows, "y", "work_mode", ("zpdes", "playlist"), "module_code", "classroom_id"))
