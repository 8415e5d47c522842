"""Queries of catalog audits, labels, selectors, graph metrics and text of exercises."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ENTITIES, html_text
from ..operators import audit as A, catalog as C, daily as D, evidence as E, graph as G, paths as P, progression as PR, quality as Q, ratings as R, slices as S
from ..operators.classroom import selection_profiles
from ..sources import adapters as AD, ingest as I
from ..sources.attempts_view import ATTEMPTS_SQL, attempts
from .concentration import START_SQL, same_item
from .daily import DAILY_SQL, rounded
from .ingest import GRAPH_SQL, rules
from .paths import runs_sql
from .progression import CATALOG_SQL, derived
from .registry import register


@register("attempts_of_classroom", ATTEMPTS_SQL + " SELECT event_id, user_id, exercise_id FROM attempts WHERE classroom_id = 'c1'")
def attempts_of_classroom(spark, sf_dir):
    return S.by_id(attempts(spark, sf_dir), "classroom_id", "c1").select("event_id", "user_id", "exercise_id")


@register("eligible_student", ATTEMPTS_SQL + " SELECT user_id, count(*) AS attempts FROM attempts WHERE user_id = 'u3' GROUP BY user_id HAVING count(*) >= 20")
def eligible_student(spark, sf_dir):
    return S.by_id(selection_profiles(attempts(spark, sf_dir), 20), "user_id", "u3", "eligible").select("user_id", "attempts")


@register("unattempted_exercises", CATALOG_SQL + " SELECT DISTINCT exercise_id FROM catalog WHERE exercise_id NOT IN (SELECT exercise_id FROM attempts WHERE work_mode = 'initial-test' AND user_id IS NOT NULL)")
def unattempted_exercises(spark, sf_dir):
    return Q.unattempted(attempts(spark, sf_dir).filter("work_mode = 'initial-test' and user_id is not null"), derived(spark, sf_dir))


@register(
    "duplicate_ids",
    CATALOG_SQL
    + " "
    + " UNION ALL ".join(f"SELECT '{c}' AS level, {c} AS id, count(DISTINCT {p}) AS parents FROM catalog GROUP BY {c} HAVING count(DISTINCT {p}) > 1" for c, p in (("objective_id", "module_id"), ("activity_id", "objective_id"), ("exercise_id", "activity_id"))),
)
def duplicate_ids(spark, sf_dir):
    return Q.duplicate_ids(derived(spark, sf_dir))


@register(
    "metadata_audit",
    CATALOG_SQL
    + """, listed AS (SELECT DISTINCT exercise_id, CASE WHEN CAST(substr(exercise_id, 2) AS INTEGER) % 3 = 0 THEN 'quiz' WHEN CAST(substr(exercise_id, 2) AS INTEGER) % 3 = 1 THEN 'text' END AS kind FROM catalog WHERE activity_id <> 'a0')
SELECT coalesce(kind, 'unknown') AS kind, count(*) AS exercises FROM listed GROUP BY 1
UNION ALL SELECT 'unmapped', count(DISTINCT exercise_id) FROM attempts WHERE exercise_id NOT IN (SELECT exercise_id FROM listed)""",
)
def metadata_audit(spark, sf_dir):
    number = F.substring("exercise_id", 2, 9).cast("int") % 3
    listed = derived(spark, sf_dir).filter("activity_id <> 'a0'").select("exercise_id", F.when(number == 0, "quiz").when(number == 1, "text").alias("exercise_type")).distinct()
    return A.metadata_audit(listed, attempts(spark, sf_dir))


@register(
    "extended_activities",
    CATALOG_SQL
    + """, part AS (SELECT * FROM catalog WHERE exercise_id NOT LIKE '%7' AND activity_id <> 'a3'), met AS (SELECT DISTINCT activity_id, exercise_id FROM attempts WHERE activity_id IS NOT NULL AND exercise_id IS NOT NULL)
SELECT activity_id, exercise_id, p.module_id, p.module_code, p.objective_id FROM met JOIN (SELECT DISTINCT module_id, module_code, objective_id, activity_id FROM part) p USING (activity_id)
WHERE (activity_id, exercise_id) NOT IN (SELECT (activity_id, exercise_id) FROM part)""",
)
def extended_activities(spark, sf_dir):
    return I.extend_activities(attempts(spark, sf_dir), derived(spark, sf_dir).filter("exercise_id not like '%7' and activity_id <> 'a3'"))


_EXTENDED_SQL = (
    CATALOG_SQL
    + """, part AS (SELECT * FROM catalog WHERE objective_order <> 2 AND NOT (objective_order = 1 AND activity_order = 2) AND exercise_id NOT LIKE '%7'),
known AS (SELECT DISTINCT module_id, module_code, objective_id, objective_code, activity_id, activity_code FROM part),
owner AS (SELECT objective_id, arg_min(module_code, (created_at, module_code)) AS module_code FROM attempts WHERE objective_id IS NOT NULL AND module_code IS NOT NULL GROUP BY 1),
top_objective AS (SELECT module_code, max(CAST(regexp_extract(objective_code, 'O([0-9]+)$', 1) AS INTEGER)) AS used FROM known GROUP BY 1),
lost AS (SELECT objective_id, module_code, row_number() OVER (PARTITION BY module_code ORDER BY objective_id) AS k FROM owner WHERE objective_id NOT IN (SELECT objective_id FROM known)),
parents AS (SELECT DISTINCT module_id, module_code, objective_id, objective_code FROM known UNION
  SELECT m.module_id, l.module_code, l.objective_id, l.module_code || 'O' || (coalesce(used, 0) + k) FROM lost l JOIN (SELECT DISTINCT module_id, module_code FROM known) m USING (module_code) LEFT JOIN top_objective USING (module_code)),
place AS (SELECT activity_id, arg_min(objective_id, (created_at, objective_id)) AS objective_id FROM attempts WHERE activity_id IS NOT NULL AND objective_id IS NOT NULL GROUP BY 1),
top_activity AS (SELECT objective_code, max(CAST(regexp_extract(activity_code, 'A([0-9]+)$', 1) AS INTEGER)) AS used FROM known GROUP BY 1),
new AS (SELECT p.*, pl.activity_id, row_number() OVER (PARTITION BY p.objective_code ORDER BY pl.activity_id) AS k FROM place pl JOIN parents p USING (objective_id) WHERE pl.activity_id NOT IN (SELECT activity_id FROM known)),
spots AS (SELECT * FROM known UNION ALL SELECT module_id, module_code, objective_id, n.objective_code, activity_id, n.objective_code || 'A' || (coalesce(used, 0) + k) FROM new n LEFT JOIN top_activity USING (objective_code)),
pairs AS (SELECT activity_id, exercise_id FROM part UNION SELECT activity_id, exercise_id FROM attempts WHERE activity_id IS NOT NULL AND exercise_id IS NOT NULL),
extended AS (SELECT spots.*, exercise_id FROM spots LEFT JOIN pairs USING (activity_id))"""
)


def _extended(spark, sf_dir):
    part = derived(spark, sf_dir).filter("objective_order <> 2 and not (objective_order = 1 and activity_order = 2) and exercise_id not like '%7'")
    return AD.extended_catalog(attempts(spark, sf_dir), part)


@register("extended_catalog", _EXTENDED_SQL + " SELECT module_id, module_code, objective_id, objective_code, activity_id, activity_code, exercise_id FROM extended")
def extended_catalog(spark, sf_dir):
    return _extended(spark, sf_dir).select("module_id", "module_code", "objective_id", "objective_code", "activity_id", "activity_code", "exercise_id")


@register(
    "completed_attempts",
    _EXTENDED_SQL
    + """, bare AS (SELECT * REPLACE (CASE WHEN event_id % 3 <> 0 THEN activity_id END AS activity_id, CASE WHEN event_id % 2 <> 0 THEN objective_id END AS objective_id) FROM attempts),
a AS (SELECT activity_id AS k, min((objective_id, module_id)) AS p FROM extended GROUP BY 1), o AS (SELECT objective_id AS k, min(module_id) AS m FROM extended GROUP BY 1), e AS (SELECT exercise_id AS k, min((module_id, objective_id, activity_id)) AS p FROM extended WHERE exercise_id IS NOT NULL GROUP BY 1)
SELECT event_id, coalesce(b.activity_id, e.p[3]) AS activity_id, coalesce(b.objective_id, a.p[1], e.p[2]) AS objective_id,
  coalesce(a.p[2], o.m, e.p[1], CASE WHEN playlist_or_module_id IN (SELECT module_id FROM extended) THEN playlist_or_module_id END) AS module_id
FROM bare b LEFT JOIN a ON a.k = b.activity_id LEFT JOIN o ON o.k = b.objective_id LEFT JOIN e ON e.k = b.exercise_id""",
)
def completed_attempts(spark, sf_dir):
    rows = attempts(spark, sf_dir).withColumns({"activity_id": F.when(F.col("event_id") % 3 != 0, F.col("activity_id")), "objective_id": F.when(F.col("event_id") % 2 != 0, F.col("objective_id"))})
    return AD.completed(rows, _extended(spark, sf_dir)).select("event_id", "activity_id", "objective_id", "module_id")


@register("config_hierarchy", CATALOG_SQL + " SELECT DISTINCT module_id, module_code, objective_id, objective_code, activity_id, activity_code, exercise_id FROM catalog")
def config_hierarchy(spark, sf_dir):
    rows, out = derived(spark, sf_dir), None
    for level in ("module", "objective", "activity"):
        part = rows.groupBy(F.col(f"{level}_id").alias("id"), F.col(f"{level}_code").alias("code")).agg(F.min(f"{level}_label").alias("label"), F.collect_set("exercise_id").alias("exercise_ids")).withColumn("type", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return AD.config_hierarchy(out).select("module_id", "module_code", "objective_id", "objective_code", "activity_id", "activity_code", "exercise_id")


@register(
    "config_parents",
    CATALOG_SQL
    + """, config AS (SELECT DISTINCT module_id AS id, 'module' AS type, module_code AS code FROM catalog UNION SELECT DISTINCT objective_id, 'objective', objective_code FROM catalog UNION SELECT DISTINCT activity_id, 'activity', activity_code FROM catalog)
SELECT c.id, c.type, c.code, p.id AS parent_id, p.code AS parent_code FROM config c LEFT JOIN config p ON c.type <> 'module' AND p.code = CASE c.type WHEN 'activity' THEN split_part(c.code, 'A', 1) ELSE split_part(c.code, 'O', 1) END""",
)
def config_parents(spark, sf_dir):
    rows, out = derived(spark, sf_dir), None
    for level in ("module", "objective", "activity"):
        part = rows.select(F.col(f"{level}_id").alias("id"), F.lit(level).alias("type"), F.col(f"{level}_code").alias("code")).distinct()
        out = part if out is None else out.unionByName(part)
    return I.config_parents(out).select("id", "type", "code", "parent_id", "parent_code")


def _code_maps(spark, sf_dir):
    """Rules with the two code maps, and the label index, of the derived catalog."""
    rows = derived(spark, sf_dir)
    pairs = rows.select(F.explode(F.array(*[F.struct(F.col(f"{x}_code").alias("code"), F.col(f"{x}_id").alias("id"), F.col(f"{x}_label").alias("label")) for x in ("module", "objective", "activity")])).alias("p")).select("p.*").distinct()
    maps = pairs.agg(F.map_from_entries(F.collect_set(F.struct("code", "id"))).alias("code_to_id"))
    return maps.select(F.struct("code_to_id").alias("map_id_code")), pairs.select("id", "label").distinct()


@register("code_fallbacks", CATALOG_SQL + " SELECT DISTINCT objective_id AS id, objective_code AS code, objective_label AS label FROM catalog")
def code_fallbacks(spark, sf_dir):
    found, index = _code_maps(spark, sf_dir)
    return C.code_fallbacks(found, index, "objective").select("id", "code", "label")


_PAIRS = [("activity_id", "activity_label"), ("objective_id", "objective_label"), ("module_id", "module_label")]
_BARE = "CASE WHEN event_id % 4 <> 0 THEN activity_label END AS activity_label, CASE WHEN event_id % 9 <> 0 THEN objective_label END AS objective_label"


@register("label_report", ATTEMPTS_SQL + f", bare AS (SELECT * REPLACE ({_BARE}) FROM attempts) " + " UNION ALL ".join(f"SELECT '{i}' AS level, count(*) AS rows, count(DISTINCT {i}) AS ids FROM bare WHERE {i} IS NOT NULL AND {x} IS NULL HAVING count(*) > 0" for i, x in _PAIRS))
def label_report(spark, sf_dir):
    return Q.label_report(_bare(spark, sf_dir), _PAIRS)


def _bare(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    return rows.withColumns({"activity_label": F.when(F.col("event_id") % 4 != 0, F.col("activity_label")), "objective_label": F.when(F.col("event_id") % 9 != 0, F.col("objective_label"))})


@register("labels_from_ids", ATTEMPTS_SQL + f", bare AS (SELECT * REPLACE ({_BARE}) FROM attempts) SELECT event_id, coalesce(activity_label, activity_id) AS activity_label, coalesce(objective_label, objective_id) AS objective_label, exercise_id AS exercise_label FROM bare")
def labels_from_ids(spark, sf_dir):
    return Q.with_labels(_bare(spark, sf_dir), [*_PAIRS[:2], ("exercise_id", "exercise_label")]).select("event_id", "activity_label", "objective_label", "exercise_label")


@register("induced_graph", GRAPH_SQL + ", picked AS (SELECT DISTINCT activity_code FROM catalog WHERE objective_order = 1) SELECT * FROM graph WHERE source IN (SELECT activity_code FROM picked) AND target IN (SELECT activity_code FROM picked)")
def induced_graph(spark, sf_dir):
    nodes = derived(spark, sf_dir).filter("objective_order = 1").select(F.col("activity_code").alias("node"))
    return G.induced(C.requirement_edges(rules(spark, sf_dir)), nodes)


@register("node_metric_mode", ATTEMPTS_SQL + """, nodes AS (SELECT DISTINCT activity_id FROM attempts WHERE activity_id IS NOT NULL UNION ALL SELECT NULL)
SELECT n.activity_id, round(m, 6) AS metric FROM nodes n LEFT JOIN (SELECT activity_id, avg(CAST(data_correct AS INTEGER)) AS m FROM attempts WHERE attempt_number = 1 AND work_mode = 'zpdes' AND module_code IS NOT NULL GROUP BY 1) f USING (activity_id)""")
def node_metric_mode(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    nodes = rows.select("activity_id").filter("activity_id is not null").distinct().unionByName(spark.sql("select cast(null as string) as activity_id"))
    return rounded(PR.node_metric(nodes, None, PR.mode_first_attempts(rows.filter("module_code is not null")), "zpdes"))


@register("node_metric_rating", START_SQL + f", base AS (SELECT DISTINCT module_code, objective_id, activity_id, exercise_id FROM ctx WHERE exercise_id IS NOT NULL AND activity_id IS NOT NULL) SELECT x.activity_id, round(avg(rating), 6) AS metric FROM base x LEFT JOIN items i ON {same_item('x', 'i')} GROUP BY x.activity_id")
def node_metric_rating(spark, sf_dir):
    rows = attempts(spark, sf_dir).filter("activity_id is not null")
    rated = R.activity_ratings(R.item_base(rows), R.smoothed_start(R.calibration_rows(attempts(spark, sf_dir))))
    return rounded(PR.node_metric(rows.select("activity_id").distinct(), rated, None))


@register(
    "individual_findings",
    CATALOG_SQL
    + """, visible AS (SELECT *, activity_id IN (SELECT activity_id FROM catalog WHERE module_code = 'M1') AND activity_id IS NOT NULL AS mapped FROM attempts WHERE student_attempt_index <= 40 AND user_id IS NOT NULL),
moves AS (SELECT user_id, student_attempt_index AS pos, lag(activity_id) OVER (PARTITION BY user_id ORDER BY student_attempt_index) AS f, activity_id AS t FROM visible WHERE mapped),
recent AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS r FROM moves WHERE f <> t),
texts AS (SELECT user_id, string_agg(f || ' -> ' || t, ' | ' ORDER BY pos) AS recent_moves FROM recent WHERE r <= 3 GROUP BY user_id)
SELECT v.user_id, count(*) AS visible_attempts, count(*) FILTER (WHERE mapped) AS mapped_attempts, count(*) FILTER (WHERE NOT mapped) AS unmapped_attempts, count(DISTINCT activity_id) FILTER (WHERE mapped) AS mapped_activities,
  round(avg(CAST(coalesce(data_correct, false) AS INTEGER)) FILTER (WHERE mapped), 6) AS mapped_success_rate, any_value(recent_moves) AS recent_moves FROM visible v LEFT JOIN texts USING (user_id) GROUP BY v.user_id""",
)
def individual_findings(spark, sf_dir):
    return rounded(P.individual_findings(attempts(spark, sf_dir), 40, derived(spark, sf_dir).filter("module_code = 'M1'")))


@register(
    "probability_curve",
    runs_sql("student")
    + """, places AS (SELECT DISTINCT work_mode, position FROM runs WHERE work_mode IN ('zpdes', 'playlist')), linear AS (
  SELECT *, 0.4::DOUBLE + CASE WHEN work_mode = 'zpdes' THEN 0.3::DOUBLE ELSE 0 END + 0.01::DOUBLE * position - CASE WHEN work_mode = 'zpdes' THEN 0.002::DOUBLE * position ELSE 0 END AS x FROM places
) SELECT work_mode, position, position + 1 AS attempt_number, round(x, 6) AS linear_predictor, round(1 / (1 + exp(-x)), 6) AS predicted_probability FROM linear""",
)
def probability_curve(spark, sf_dir):
    fitted = spark.createDataFrame([("intercept", 0.4), ("zpdes", 0.3), ("position", 0.01), ("interaction", -0.002)], "term string, estimate double")
    return rounded(E.probability_curve(P.trajectories(attempts(spark, sf_dir)).filter("work_mode in ('zpdes', 'playlist')"), fitted))


def _text_sql(column: str) -> str:
    for entity, plain in ENTITIES:
        column = f"replace({column}, '{entity.replace(QUOTE, QUOTE * 2)}', '{plain.replace(QUOTE, QUOTE * 2)}')"
    return f"trim(regexp_replace(regexp_replace({column}, '<[^>]+>', ' ', 'g'), '[\\s\\x{{00a0}}]+', ' ', 'g'))"


QUOTE = chr(39)


@register("page_text", f"SELECT page_id, {_text_sql('html')} AS text FROM pages")
def page_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html_text(F.col("html")).alias("text"))
