"""Queries of the measurement-feasibility audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A, graph as G, paths as P
from ..sources.attempts_view import ATTEMPTS_SQL, attempts
from .daily import rounded
from .paths import FIRST_SQL
from .progression import CATALOG_SQL, derived
from .registry import register

#: What the audit reads: rows with student, exercise, time, outcome and ordinals.
ANSWERED_SQL = ATTEMPTS_SQL + ", answered AS (SELECT * FROM attempts WHERE trim(user_id) <> '' AND trim(exercise_id) <> '' AND created_at IS NOT NULL AND data_correct IS NOT NULL)"
#: First exposures in the adaptive mode: the earliest first attempt of a student at an exercise.
ADAPTIVE_SQL = (
    ANSWERED_SQL
    + """, adaptive AS (
  SELECT * FROM answered WHERE attempt_number = 1 AND work_mode = 'zpdes' QUALIFY row_number() OVER (PARTITION BY user_id, exercise_id ORDER BY created_at, event_id) = 1
)"""
)

PAIRS_SQL = (
    ATTEMPTS_SQL
    + """, took AS (SELECT DISTINCT user_id, module_code, exercise_id FROM attempts),
pairs AS (
  SELECT l.module_code, l.exercise_id AS left_exercise_id, r.exercise_id AS right_exercise_id, count(*) AS shared_students
  FROM took l JOIN took r ON l.user_id = r.user_id AND l.module_code = r.module_code AND l.exercise_id < r.exercise_id GROUP BY 1, 2, 3
)"""
)


@register("exercise_pairs", PAIRS_SQL + " SELECT * FROM pairs")
def exercise_pairs(spark, sf_dir):
    return A.exercise_pairs(attempts(spark, sf_dir))


_HISTOGRAM_SQL = (
    PAIRS_SQL
    + """, histogram AS (SELECT shared_students AS v, count(*) AS k FROM pairs GROUP BY 1), steps AS (SELECT *, sum(k) OVER (ORDER BY v) AS upto, sum(k) OVER () AS n FROM histogram)
SELECT CAST(max(n) AS BIGINT) AS n, round(sum(v * k) / max(n), 6) AS mean, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max,
  round(sqrt((sum(CAST(v AS DOUBLE) * v * k) - sum(v * k) * (sum(v * k) / max(n))) / max(n)), 6) AS sd, """
    + ", ".join(f"CAST(min(v) FILTER (WHERE upto >= greatest(1, ceil({p}::DOUBLE * n))) AS DOUBLE) AS p{round(p * 100)}" for p in A.PERCENTS)
    + ", 'shared_students' AS measure FROM steps"
)


@register("overlap_histogram_distribution", _HISTOGRAM_SQL)
def overlap_histogram_distribution(spark, sf_dir):
    return rounded(A.histogram_distribution(A.overlap_distribution(A.exercise_pairs(attempts(spark, sf_dir))), "shared_students", "pairs", "shared_students"))


@register("overlap_distribution", PAIRS_SQL + " SELECT shared_students, count(*) AS pairs FROM pairs GROUP BY 1")
def overlap_distribution(spark, sf_dir):
    return A.overlap_distribution(A.exercise_pairs(attempts(spark, sf_dir)))


COMPONENT_SQL = (
    ATTEMPTS_SQL.replace("WITH raw_events", "WITH RECURSIVE raw_events", 1)
    + """, links AS (SELECT DISTINCT 's:' || user_id AS s, 'e:' || exercise_id AS e FROM attempts WHERE work_mode = 'initial-test' AND user_id IS NOT NULL AND exercise_id IS NOT NULL),
both_ways AS (SELECT s AS a, e AS b FROM links UNION ALL SELECT e, s FROM links),
reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other)"""
)


def _bipartite(spark, sf_dir):
    rows = attempts(spark, sf_dir).filter("work_mode = 'initial-test'")
    return rows.select(F.concat(F.lit("s:"), "user_id").alias("a"), F.concat(F.lit("e:"), "exercise_id").alias("b"))


@register("bipartite_components", COMPONENT_SQL + " SELECT node, min(other) AS component FROM reach GROUP BY node")
def bipartite_components(spark, sf_dir):
    return G.components(_bipartite(spark, sf_dir))


@register("component_sizes", COMPONENT_SQL + " SELECT component, count(*) AS size FROM (SELECT node, min(other) AS component FROM reach GROUP BY node) GROUP BY component")
def component_sizes(spark, sf_dir):
    edges = _bipartite(spark, sf_dir)
    return G.component_sizes(G.components(edges), edges.select(F.explode(F.array("a", "b")).alias("node")))


@register("two_core")
def two_core(spark, sf_dir):
    return G.two_core(_bipartite(spark, sf_dir))


PROJECTED_SQL = (
    PAIRS_SQL.replace("WITH raw_events", "WITH RECURSIVE raw_events", 1)
    + """, linked AS (SELECT left_exercise_id AS a, right_exercise_id AS b FROM pairs WHERE shared_students >= 20), two_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT DISTINCT a AS node, a AS other FROM two_ways UNION SELECT r.node, t.b FROM reach r JOIN two_ways t ON t.a = r.other)
SELECT node, min(other) AS component FROM reach GROUP BY node"""
)


@register("projected_components", PROJECTED_SQL)
def projected_components(spark, sf_dir):
    return A.projected_components(A.exercise_pairs(attempts(spark, sf_dir)), 20)


SPARSITY_SQL = (
    FIRST_SQL
    + """, per_exercise AS (
  SELECT exercise_id, count(*) AS n, count(*) FILTER (WHERE attempt_number = 1) AS first_n, avg(CAST(data_correct AS INTEGER)) FILTER (WHERE attempt_number = 1) AS r FROM attempts GROUP BY 1
), sparse AS (
  SELECT (SELECT count(*) FROM attempts) AS attempts, (SELECT count(DISTINCT user_id) FROM attempts) AS students, (SELECT count(DISTINCT exercise_id) FROM attempts) AS exercises,
    CAST(sum(first_n) AS BIGINT) AS first_exposures, avg(n) AS mean_attempts_per_exercise, avg(r) AS mean_first_success, count(*) FILTER (WHERE first_n < 20) AS exercises_below_20 FROM per_exercise
)"""
)


@register("sparsity", SPARSITY_SQL + " SELECT attempts, students, exercises, first_exposures, round(mean_attempts_per_exercise, 6) AS mean_attempts_per_exercise, round(mean_first_success, 6) AS mean_first_success, exercises_below_20, round(CAST(first_exposures AS DOUBLE) / (students * exercises), 6) AS density FROM sparse")
def sparsity(spark, sf_dir):
    return rounded(A.sparsity(attempts(spark, sf_dir)))


@register(
    "coverage",
    CATALOG_SQL
    + """, took AS (SELECT DISTINCT user_id, module_code, exercise_id FROM attempts), sizes AS (SELECT module_code, count(DISTINCT exercise_id) AS size FROM catalog GROUP BY 1)
SELECT t.user_id, count(DISTINCT exercise_id) AS exercises, round(CAST(count(DISTINCT exercise_id) AS DOUBLE) / (SELECT count(DISTINCT exercise_id) FROM catalog), 6) AS catalog_share,
  round(CAST(count(DISTINCT exercise_id) AS DOUBLE) / CAST(any_value(e.entered) AS DOUBLE), 6) AS entered_share
FROM took t JOIN (SELECT user_id, sum(size) AS entered FROM (SELECT DISTINCT user_id, module_code FROM took) JOIN sizes USING (module_code) GROUP BY 1) e USING (user_id) GROUP BY t.user_id""",
)
def coverage(spark, sf_dir):
    return rounded(A.coverage(attempts(spark, sf_dir), derived(spark, sf_dir)))


def _distribution_sql(value: str, source: str, name: str) -> str:
    cut = lambda p: f"(SELECT v FROM ordered_values WHERE i = round_even({p}::DOUBLE * ((SELECT count(*) FROM ordered_values) - 1), 0))"
    return f", ordered_values AS (SELECT CAST({value} AS DOUBLE) AS v, row_number() OVER (ORDER BY {value}) - 1 AS i FROM {source}) SELECT count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS min, max(v) AS max, " + ", ".join(f"{cut(p)} AS p{round(p * 100)}" for p in A.PERCENTS) + f", '{name}' AS measure FROM ordered_values"


@register("attempts_per_student_distribution", ATTEMPTS_SQL + ", per_user AS (SELECT user_id, count(*) AS k FROM attempts GROUP BY 1)" + _distribution_sql("k", "per_user", "attempts_per_student"))
def attempts_per_student_distribution(spark, sf_dir):
    per = attempts(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("k"))
    return rounded(A.distribution(per, "k", "attempts_per_student"))


BAND = """SELECT count(*) AS entities, round(avg(r), 6) AS mean_rate, round(stddev_samp(r), 6) AS sd_rate, round(avg(CASE WHEN r BETWEEN 0.65 AND 0.85 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_in_band FROM rates"""


def _adaptive(spark, sf_dir):
    return P.first_exposures(A.answered(attempts(spark, sf_dir)), "zpdes")


@register("success_band", ADAPTIVE_SQL + ", rates AS (SELECT exercise_id, avg(CAST(data_correct AS INTEGER)) AS r FROM adaptive GROUP BY 1) " + BAND)
def success_band(spark, sf_dir):
    return rounded(A.success_band(_adaptive(spark, sf_dir), "exercise_id"))


@register("student_success_band", ADAPTIVE_SQL + ", rates AS (SELECT user_id, avg(CAST(data_correct AS INTEGER)) AS r FROM adaptive GROUP BY 1) " + BAND)
def student_success_band(spark, sf_dir):
    return rounded(A.success_band(_adaptive(spark, sf_dir), "user_id"))


def _deltas_sql(source: str, ordinal: str, name: str) -> str:
    """Success of the first and last fifth, from totals of ``source`` and its ordinals."""
    return f""", {name}_totals AS (SELECT user_id, count(*) AS total, greatest(1, CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT)) AS fifth FROM {source} GROUP BY 1),
{name} AS (
  SELECT t.user_id, max(total) AS exposures, avg(CAST(data_correct AS INTEGER)) FILTER (WHERE {ordinal} <= fifth) AS early, avg(CAST(data_correct AS INTEGER)) FILTER (WHERE {ordinal} > total - fifth) AS late
  FROM {name}_totals t JOIN {source} USING (user_id) GROUP BY t.user_id
)"""


FIRST_DELTAS_SQL = """, starts AS (
  SELECT * FROM answered WHERE attempt_number = 1 QUALIFY row_number() OVER (PARTITION BY user_id, exercise_id ORDER BY created_at, event_id) = 1
), starting AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY student_attempt_index) AS nth FROM starts)""" + _deltas_sql("starting", "nth", "of_firsts")


@register("early_late_delta", ANSWERED_SQL + _deltas_sql("answered", "student_attempt_index", "of_all") + " SELECT user_id, exposures, round(early, 6) AS early, round(late, 6) AS late, round(late - early, 6) AS delta FROM of_all")
def early_late_delta(spark, sf_dir):
    return rounded(A.early_late(A.answered(attempts(spark, sf_dir))))


def _summary_sql(source: str, scope: str) -> str:
    cut = ", ".join(f"(SELECT d FROM {source}_sorted WHERE i = round_even({p}::DOUBLE * ((SELECT count(*) FROM {source}_sorted) - 1), 0)) AS p{round(p * 100)}" for p in A.PERCENTS)
    return f"SELECT count(late - early) AS n, avg(late - early) AS mean, stddev_samp(late - early) AS sd, min(late - early) AS min, max(late - early) AS max, {cut}, '{scope}' AS scope, count(*) AS students, median(late - early) AS median_delta, CAST(count(*) FILTER (WHERE late > early) AS DOUBLE) / greatest(count(*), 1) AS share_improved FROM {source}"


@register(
    "early_late_summary",
    ANSWERED_SQL
    + _deltas_sql("answered", "student_attempt_index", "of_all")
    + FIRST_DELTAS_SQL
    + "".join(f", {x}_sorted AS (SELECT late - early AS d, row_number() OVER (ORDER BY late - early) - 1 AS i FROM {x} WHERE late - early IS NOT NULL)" for x in ("of_all", "of_firsts"))
    + ", summaries AS ("
    + _summary_sql("of_all", "all_attempts")
    + " UNION ALL "
    + _summary_sql("of_firsts", "first_exposures")
    + ") SELECT n, students, scope, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "sd", "min", "max", "median_delta", "share_improved", *(f"p{round(p * 100)}" for p in A.PERCENTS)))
    + " FROM summaries",
)
def early_late_summary(spark, sf_dir):
    rows = A.answered(attempts(spark, sf_dir))
    firsts = A.first_exposure_ordinals(P.first_exposures(rows))
    return rounded(A.early_late_summary(A.early_late(rows), "all_attempts").unionByName(A.early_late_summary(A.early_late(firsts, "first_exposure_index"), "first_exposures")))


@register("trajectory_growth", ATTEMPTS_SQL + " SELECT user_id, count(*) AS attempts, count(DISTINCT exercise_id) AS exercises, CAST(floor((epoch(max(created_at)) - epoch(min(created_at))) / 86400) AS BIGINT) AS elapsed_days FROM attempts GROUP BY user_id")
def trajectory_growth(spark, sf_dir):
    return A.growth(attempts(spark, sf_dir))


#: An exposure starts where the attempt number does not rise; its first row is the start itself.
EXPOSURES_SQL = (
    ANSWERED_SQL
    + """, numbered AS (
  SELECT *, CASE WHEN attempt_number > lag(attempt_number) OVER (PARTITION BY user_id, exercise_id ORDER BY created_at, attempt_number) THEN 0 ELSE 1 END AS starts_here FROM answered
), exposed AS (SELECT *, sum(starts_here) OVER (PARTITION BY user_id, exercise_id ORDER BY created_at, attempt_number) - 1 AS nth FROM numbered),
exposures AS (
  SELECT user_id, exercise_id, nth, max(attempt_number) - 1 AS retries, CAST(arg_min(data_correct, (created_at, attempt_number)) AS INTEGER) AS correct FROM exposed GROUP BY ALL
)"""
)


@register(
    "retry_summary",
    EXPOSURES_SQL
    + """ SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id, exercise_id FROM exposures)) AS pairs, count(*) FILTER (WHERE nth = 0 AND correct = 0) AS first_failures,
  round(CAST(count(*) FILTER (WHERE nth = 0 AND correct = 0 AND retries > 0) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE nth = 0 AND correct = 0)), 6) AS retry_share_after_failure,
  round(avg(correct), 6) AS first_attempt_success,
  round((SELECT avg(CAST(data_correct AS INTEGER)) FROM answered WHERE attempt_number = 2), 6) AS second_attempt_success,
  round((SELECT CAST(count(*) AS DOUBLE) FROM (SELECT 1 FROM exposures GROUP BY user_id, exercise_id HAVING count(*) > 1)) / (SELECT count(*) FROM (SELECT DISTINCT user_id, exercise_id FROM exposures)), 6) AS reused_pair_share
FROM exposures""",
)
def retry_summary(spark, sf_dir):
    return rounded(A.retry_summary(A.answered(attempts(spark, sf_dir))))


@register("retry_distribution", EXPOSURES_SQL + ", starting_retries AS (SELECT retries AS r FROM exposures WHERE nth = 0)" + _distribution_sql("r", "starting_retries", "first_exposure_retries"))
def retry_distribution(spark, sf_dir):
    return rounded(A.retry_distribution(A.answered(attempts(spark, sf_dir))))


TAIL_SQL = (
    PAIRS_SQL
    + """, ends AS (SELECT left_exercise_id AS exercise_id, shared_students FROM pairs UNION ALL SELECT right_exercise_id, shared_students FROM pairs),
degrees AS (SELECT exercise_id, count(*) AS degree, min(shared_students) AS min_overlap, median(shared_students) AS median_overlap, max(shared_students) AS max_overlap FROM ends GROUP BY 1),
quantiles AS (SELECT exercise_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at, exercise_id, event_id) AS DOUBLE) / count(*) OVER (PARTITION BY user_id) AS q FROM attempts WHERE attempt_number = 1),
late AS (SELECT exercise_id, quantile_cont(q, 0.1) AS p10 FROM quantiles GROUP BY 1),
ordered_degrees AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM degrees),
low AS (SELECT degree AS low_degree FROM ordered_degrees WHERE i = round_even(0.1::DOUBLE * (n - 1), 0))
SELECT d.exercise_id, degree, min_overlap, CAST(median_overlap AS DOUBLE) AS median_overlap, max_overlap, round(p10, 6) AS p10_progress FROM degrees d LEFT JOIN late USING (exercise_id), low WHERE degree <= low_degree OR p10 >= 0.9"""
)


@register("tail_exercises", TAIL_SQL)
def tail_exercises(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    return rounded(A.tail_exercises(A.exercise_pairs(rows), P.progress_quantiles(P.first_exposures(rows))))


MODULE_TAIL_SQL = (
    FIRST_SQL.replace("WITH raw_events", "WITH RECURSIVE raw_events", 1)
    + """, took AS (SELECT DISTINCT user_id, module_code, exercise_id FROM firsts), nodes AS (SELECT DISTINCT module_code, exercise_id FROM took),
shared AS (
  SELECT module_code, l.exercise_id, r.exercise_id AS other, count(*) AS shared_students FROM took l JOIN took r USING (user_id, module_code) WHERE l.exercise_id <> r.exercise_id GROUP BY 1, 2, 3
), reach AS (SELECT module_code, exercise_id, exercise_id AS other FROM nodes UNION SELECT r.module_code, r.exercise_id, s.other FROM reach r JOIN shared s ON s.module_code = r.module_code AND s.exercise_id = r.other),
sizes AS (SELECT module_code, exercise_id, count(*) AS component_exercises FROM reach GROUP BY 1, 2),
degrees AS (
  SELECT n.module_code, n.exercise_id, count(other) AS degree, coalesce(min(shared_students), 0) AS min_overlap, coalesce(median(shared_students), 0) AS median_overlap, coalesce(max(shared_students), 0) AS max_overlap
  FROM nodes n LEFT JOIN shared USING (module_code, exercise_id) GROUP BY 1, 2
), quantiles AS (SELECT module_code, exercise_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at, exercise_id, event_id) AS DOUBLE) / count(*) OVER (PARTITION BY user_id) AS q FROM firsts),
late AS (SELECT module_code, exercise_id, count(DISTINCT user_id) AS first_attempt_students, quantile_cont(q, 0.1) AS p10 FROM quantiles GROUP BY 1, 2),
placed AS (SELECT module_code, degree, row_number() OVER (PARTITION BY module_code ORDER BY degree) - 1 AS i, count(*) OVER (PARTITION BY module_code) AS n FROM degrees),
low AS (SELECT module_code, degree AS low_degree FROM placed WHERE i = round_even(0.1::DOUBLE * (n - 1), 0)), largest AS (SELECT module_code, max(component_exercises) AS largest FROM sizes GROUP BY 1)
SELECT module_code, exercise_id, first_attempt_students, degree, min_overlap, CAST(median_overlap AS DOUBLE) AS median_overlap, max_overlap, component_exercises, round(p10, 6) AS p10_progress
FROM degrees JOIN sizes USING (module_code, exercise_id) JOIN late USING (module_code, exercise_id) JOIN low USING (module_code) JOIN largest USING (module_code)
WHERE degree <= low_degree OR component_exercises < largest OR p10 >= 0.9"""
)


@register("tail_exercises_by_module", MODULE_TAIL_SQL)
def tail_exercises_by_module(spark, sf_dir):
    return rounded(A.module_tails(P.progress_quantiles(P.first_exposures(attempts(spark, sf_dir)))))


VERDICT_SQL = (
    ADAPTIVE_SQL.replace("WITH raw_events", "WITH RECURSIVE raw_events", 1)
    + """, near AS (SELECT DISTINCT l.exercise_id AS a, r.exercise_id AS b FROM adaptive l JOIN adaptive r USING (user_id)),
reach AS (SELECT a, a AS b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
parts AS (SELECT a AS exercise_id, min(b) AS part FROM reach GROUP BY 1),
sizes AS (SELECT part, count(DISTINCT exercise_id) AS exercises, count(DISTINCT user_id) AS students FROM adaptive JOIN parts USING (exercise_id) GROUP BY 1),
largest AS (SELECT exercises AS n FROM sizes ORDER BY exercises + students DESC, exercises DESC LIMIT 1),
starts AS (SELECT DISTINCT user_id, exercise_id FROM answered WHERE attempt_number = 1),
scale AS (SELECT exercise_id, count(s.user_id) AS firsts FROM (SELECT DISTINCT exercise_id FROM answered) LEFT JOIN starts s USING (exercise_id) GROUP BY 1)"""
    + _deltas_sql("answered", "student_attempt_index", "of_all")
    + """, figures AS (
  SELECT (SELECT CAST(n AS DOUBLE) FROM largest) / (SELECT count(DISTINCT exercise_id) FROM adaptive) AS exercise_share,
    (SELECT avg(CASE WHEN firsts < 20 THEN 1.0::DOUBLE ELSE 0 END) FROM scale) AS sparse_share,
    (SELECT avg(late - early) FROM of_all) AS mean_delta,
    (SELECT stddev_samp(r) FROM (SELECT avg(CAST(data_correct AS INTEGER)) AS r FROM adaptive GROUP BY exercise_id)) AS exercise_sd
) SELECT round(exercise_share, 6) AS exercise_share, round(sparse_share, 6) AS sparse_share, round(mean_delta, 6) AS mean_delta, round(exercise_sd, 6) AS exercise_sd,
  CASE WHEN exercise_share < 0.9 THEN 'disconnected' WHEN sparse_share > 0.35 THEN 'sparse' WHEN abs(mean_delta) > 0.05 THEN 'dynamic' WHEN exercise_sd < 0.05 THEN 'compressed' ELSE 'feasible' END AS verdict FROM figures"""
)


@register("feasibility_verdict", VERDICT_SQL)
def feasibility_verdict(spark, sf_dir):
    return rounded(A.verdict(attempts(spark, sf_dir)))


@register("component_shares", VERDICT_SQL.split(",\nstarts AS")[0] + """ SELECT (SELECT count(*) FROM sizes) AS components, round((SELECT CAST(n AS DOUBLE) FROM largest) / (SELECT count(DISTINCT exercise_id) FROM adaptive), 6) AS exercise_share,
  round((SELECT CAST(students AS DOUBLE) FROM sizes ORDER BY exercises + students DESC, exercises DESC LIMIT 1) / (SELECT count(DISTINCT user_id) FROM adaptive), 6) AS student_share""")
def component_shares(spark, sf_dir):
    return rounded(A.component_shares(_adaptive(spark, sf_dir)))
