"""Queries of readers, adapters, data quality and dependency graphs.

Raw inputs that the test tables lack (text lines, rules) are made from attempts by Spark,
one line or rule per row, so they grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.columns import code_of
from ..functions.lineage import stored
from ..operators import catalog as C, graph as G, quality as Q
from ..sources import ingest as I, sinks as S
from ..sources.attempts_view import ATTEMPTS_SQL, attempts
from .daily import rounded
from .progression import CATALOG_SQL, derived
from .registry import register


def researcher_lines(spark, sf_dir):
    """Attempts as lines of the researcher file; every third answer holds bare commas."""
    rows = attempts(spark, sf_dir)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    answer = F.when(F.col("event_id") % 3 == 0, F.lit("1, 2, 3")).when(F.col("event_id") % 3 == 1, F.lit('"4, 5"')).otherwise(F.lit("x"))
    fields = {
        "classroom_id": text(F.col("classroom_id")), "teacher_id": F.lit(""), "user_id": text(F.col("user_id")), "playlist_or_module_id": text(F.col("playlist_or_module_id")),
        "objective_id": text(F.col("objective_id")), "activity_id": text(F.col("activity_id")), "exercise_id": text(F.col("exercise_id")), "module_long_title": text(F.col("module_label")),
        "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "login_time": F.lit(""), "is_initial_test": F.lit("false"), "data_correct": text(F.col("data_correct")),
        "work_mode": F.when(F.col("event_id") % 5 == 0, "None").otherwise(F.col("work_mode")), "student_attempt_index": text(F.col("student_attempt_index")), "attempt_number": text(F.col("attempt_number")),
        "data_duration": text(F.col("data_duration")), "session_duration": text(F.col("session_duration")), "data_answer": answer, "data_score": F.lit("1"), "data_test_context": F.lit("ctx"), "variation": text(F.col("event_id")),
    }
    short = F.concat_ws(",", "user_id", "exercise_id")
    return rows.select(F.when(F.col("event_id") % 101 == 0, short).otherwise(F.concat(F.concat_ws(",", *fields.values()), F.lit(";;"))).alias("value"))


LINES_SQL = (
    ATTEMPTS_SQL
    + """, parsed AS (
  SELECT *, CASE WHEN event_id % 101 = 0 THEN 'skipped' WHEN event_id % 3 = 0 THEN 'repaired' ELSE 'ok' END AS row_state,
    CASE WHEN event_id % 5 = 0 THEN 'ctx' ELSE work_mode END AS mode, CASE event_id % 3 WHEN 0 THEN '1, 2, 3' WHEN 1 THEN '4, 5' ELSE 'x' END AS answer FROM attempts
)"""
)


@register("researcher_csv", LINES_SQL + " SELECT row_state, user_id, exercise_id, classroom_id, created_at, data_correct, mode AS work_mode, CAST(attempt_number AS INTEGER) AS attempt_number, data_duration, answer AS data_answer, CAST(event_id AS VARCHAR) AS variation FROM parsed WHERE row_state <> 'skipped'")
def researcher_csv(spark, sf_dir):
    rows = I.typed_researcher_rows(I.researcher_rows(researcher_lines(spark, sf_dir), I.REQUIRED))
    return rows.select("row_state", "user_id", "exercise_id", "classroom_id", "created_at", "data_correct", "work_mode", "attempt_number", "data_duration", "data_answer", "variation")


@register("ingest_counts", LINES_SQL + " SELECT row_state, count(*) AS rows FROM parsed GROUP BY row_state")
def ingest_counts(spark, sf_dir):
    return I.ingest_counts(I.researcher_rows(researcher_lines(spark, sf_dir), I.REQUIRED))


@register(
    "ingest_ordinals",
    ATTEMPTS_SQL + " SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, exercise_id) AS student_attempt_index, row_number() OVER (PARTITION BY user_id, exercise_id ORDER BY created_at) AS attempt_number FROM attempts",
)
def ingest_ordinals(spark, sf_dir):
    return I.with_ordinals(attempts(spark, sf_dir).drop("student_attempt_index", "attempt_number")).select("event_id", "student_attempt_index", "attempt_number")


@register(
    "filtered_query",
    ATTEMPTS_SQL + " SELECT event_id, user_id, work_mode, data_duration FROM attempts WHERE work_mode IN ('zpdes', 'playlist') AND data_duration BETWEEN 10 AND 60 AND module_code <> 'M2' AND attempt_number >= 2",
)
def filtered_query(spark, sf_dir):
    filters = [("work_mode", "in", ["zpdes", "playlist"]), ("data_duration", "between", (10, 60)), ("module_code", "!=", "M2"), ("attempt_number", ">=", 2)]
    return I.filtered(stored(attempts(spark, sf_dir), "attempts"), ["event_id", "user_id", "work_mode", "data_duration"], filters, [("event_id", False)])


@register(
    "standardised_attempts",
    ATTEMPTS_SQL + " SELECT 'main:' || user_id AS student_id, classroom_id, module_code AS module, work_mode, exercise_id, activity_id, created_at, CAST(data_correct AS INTEGER) AS success, 'main' AS source FROM attempts",
)
def standardised_attempts(spark, sf_dir):
    rows = attempts(spark, sf_dir).withColumn("ok", F.when(F.col("data_correct"), "Vrai").when(~F.col("data_correct"), "faux"))
    return I.standardise(rows, {"student_id": "user_id", "classroom_id": "classroom_id", "module": "module_code", "work_mode": "work_mode", "exercise_id": "exercise_id", "activity_id": "activity_id", "created_at": "created_at", "success": "ok"}, "main")


def _partial(spark, sf_dir):
    """The derived catalog without its last objective per module."""
    full = derived(spark, sf_dir)
    last = F.max("objective_order").over(Window.partitionBy("module_id"))
    return full.withColumn("_last", last).filter("objective_order < _last").drop("_last")


PARTIAL_SQL = CATALOG_SQL + ", sized AS (SELECT *, max(objective_order) OVER (PARTITION BY module_id) AS last_order FROM catalog), partial AS (SELECT * FROM sized WHERE objective_order < last_order)"


@register(
    "unmapped_objectives",
    PARTIAL_SQL
    + """, missing AS (SELECT DISTINCT module_code, objective_id FROM attempts WHERE objective_id NOT IN (SELECT objective_id FROM partial)),
used AS (SELECT module_code, max(objective_order) AS used FROM partial GROUP BY 1)
SELECT m.module_code, objective_id, m.module_code || 'O' || (coalesce(used, 0) + row_number() OVER (PARTITION BY m.module_code ORDER BY objective_id)) AS objective_code FROM missing m LEFT JOIN used USING (module_code)""",
)
def unmapped_objectives(spark, sf_dir):
    return C.synthesise_unmapped(attempts(spark, sf_dir), _partial(spark, sf_dir))


@register("orphan_activities", PARTIAL_SQL + " SELECT activity_id, count(*) AS attempts FROM attempts WHERE activity_id NOT IN (SELECT activity_id FROM partial) GROUP BY activity_id")
def orphan_activities(spark, sf_dir):
    return I.orphans(attempts(spark, sf_dir), _partial(spark, sf_dir))


@register("missing_references", PARTIAL_SQL + " " + " UNION ALL ".join(f"SELECT '{c}' AS level, {c} AS id, count(*) AS attempts FROM attempts WHERE {c} NOT IN (SELECT {c} FROM partial) GROUP BY 2" for c in ("objective_id", "activity_id", "exercise_id")))
def missing_references(spark, sf_dir):
    return Q.missing_references(attempts(spark, sf_dir), _partial(spark, sf_dir))


_CHECKED = ["created_at", "classroom_id", "session_duration", "user_id"]


@register("table_counts", ATTEMPTS_SQL + " SELECT count(*) AS rows, CAST(4 AS INTEGER) AS columns, min(created_at) AS first_at, max(created_at) AS last_at, " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_nulls" for c in _CHECKED) + " FROM attempts")
def table_counts(spark, sf_dir):
    return Q.table_counts(attempts(spark, sf_dir).select(*_CHECKED))


@register("schema_snapshot", ATTEMPTS_SQL + " " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, round(CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*), 6) AS null_ratio FROM attempts" for c, t in zip(_CHECKED, ("timestamp_ntz", "string", "double", "string"))))
def schema_snapshot(spark, sf_dir):
    return rounded(S.snapshot(attempts(spark, sf_dir).select(*_CHECKED)))


@register("baseline_assertions", ATTEMPTS_SQL + " SELECT 'classroom_id_nulls' AS name, 0.0::DOUBLE AS expected, CAST(count(*) FILTER (WHERE classroom_id IS NULL) AS DOUBLE) AS actual, count(*) FILTER (WHERE classroom_id IS NULL) = 0 AS passed FROM attempts UNION ALL SELECT 'user_id_nulls', 0.0, CAST(count(*) FILTER (WHERE user_id IS NULL) AS DOUBLE), count(*) FILTER (WHERE user_id IS NULL) = 0 FROM attempts")
def baseline_assertions(spark, sf_dir):
    return Q.assertions(Q.table_counts(attempts(spark, sf_dir).select(*_CHECKED)), {"classroom_id_nulls": 0, "user_id_nulls": 0})


def rules(spark, sf_dir):
    """Rules from the derived catalog: every activity needs the one before it, and closes the one before that."""
    w = Window.partitionBy("module_code").orderBy("objective_order", "activity_order")
    rows = derived(spark, sf_dir).select("module_code", "objective_order", "activity_order", "activity_code").distinct()
    rows = rows.select("module_code", F.col("activity_code").alias("node_code"), F.concat(F.lag("activity_code").over(w), F.lit("(75%)")).alias("requirements"), F.lag("activity_code", 2).over(w).alias("deact_requirements"), F.lit(None).cast("boolean").alias("init_open"))
    return rows.select(F.array(F.struct("module_code", "node_code", "requirements", "deact_requirements", "init_open")).alias("module_rules"))


GRAPH_SQL = (
    CATALOG_SQL
    + """, nodes AS (SELECT DISTINCT module_code, objective_order, activity_order, activity_code FROM catalog),
chain AS (SELECT module_code, activity_code AS target, lag(activity_code) OVER w AS s1, lag(activity_code, 2) OVER w AS s2 FROM nodes WINDOW w AS (PARTITION BY module_code ORDER BY objective_order, activity_order)),
graph AS (SELECT module_code, s1 AS source, target, 'activation' AS kind, 75 AS threshold FROM chain WHERE s1 IS NOT NULL UNION ALL SELECT module_code, s2, target, 'deactivation', NULL FROM chain WHERE s2 IS NOT NULL)"""
)


@register("dependency_edges", GRAPH_SQL + " SELECT * FROM graph")
def dependency_edges(spark, sf_dir):
    return C.requirement_edges(rules(spark, sf_dir))


@register("dependency_nodes", GRAPH_SQL + " SELECT module_code, activity_code AS node, activity_code NOT IN (SELECT target FROM graph WHERE kind = 'activation') AS init_open, false AS ghost FROM nodes")
def dependency_nodes(spark, sf_dir):
    r = rules(spark, sf_dir)
    return C.dependency_nodes(r, C.requirement_edges(r))


@register(
    "dependency_topology",
    GRAPH_SQL.replace("WITH raw_events", "WITH RECURSIVE raw_events", 1)
    + """, links AS (SELECT DISTINCT module_code, source, target FROM graph WHERE kind = 'activation'),
two_ways AS (SELECT module_code, source AS a, target AS b FROM links UNION ALL SELECT module_code, target, source FROM links),
near AS (SELECT DISTINCT module_code, activity_code AS node, activity_code AS other FROM nodes UNION SELECT n.module_code, n.node, t.b FROM near n JOIN two_ways t ON t.module_code = n.module_code AND t.a = n.other),
parts AS (SELECT module_code, count(DISTINCT part) AS components FROM (SELECT module_code, node, min(other) AS part FROM near GROUP BY 1, 2) GROUP BY 1),
below AS (SELECT module_code, source, target FROM links UNION SELECT b.module_code, b.source, l.target FROM below b JOIN links l ON l.module_code = b.module_code AND l.source = b.target),
rings AS (SELECT module_code, bool_or(source = target) AS cyclic FROM below GROUP BY 1),
deg AS (SELECT n.module_code, activity_code AS node, (SELECT count(*) FROM links g WHERE g.source = n.activity_code) AS o, (SELECT count(*) FROM links g WHERE g.target = n.activity_code) AS i FROM (SELECT DISTINCT module_code, activity_code FROM nodes) n),
whole AS (SELECT module_code, count(*) AS nodes, CAST(sum(o) AS BIGINT) AS edges, count(*) FILTER (WHERE i = 0) AS roots, max(o) AS max_out, max(i) AS max_in FROM deg GROUP BY 1)
SELECT w.*, components, coalesce(cyclic, false) AS cyclic, CASE WHEN cyclic THEN 'cyclic' WHEN components > 1 THEN 'disconnected_dag' WHEN max_out <= 1 AND max_in <= 1 THEN 'linear' WHEN max_in <= 1 THEN 'tree' ELSE 'general_dag' END AS topology
FROM whole w JOIN parts USING (module_code) LEFT JOIN rings USING (module_code)""",
)
def dependency_topology(spark, sf_dir):
    r = rules(spark, sf_dir)
    edges = C.requirement_edges(r).filter("kind = 'activation'")
    return G.topology(C.dependency_nodes(r, C.requirement_edges(r)).select("module_code", "node"), edges)


@register(
    "dependency_focus",
    GRAPH_SQL.replace("WITH raw_events", "WITH RECURSIVE raw_events", 1)
    + """, start_node AS (SELECT max(target) AS n FROM graph WHERE module_code = 'M1'), needs AS (
  SELECT source, target FROM graph WHERE kind = 'activation' UNION SELECT regexp_extract(activity_code, '^(M[0-9]+O[0-9]+)', 1), activity_code FROM nodes UNION SELECT 'M1O01', 'M1O02'
), up AS (SELECT source AS node FROM needs, start_node WHERE target = n UNION SELECT g.source FROM needs g JOIN up ON g.target = up.node)
SELECT node, 'ancestor' AS relation FROM up UNION ALL SELECT target, 'child' FROM graph, start_node WHERE source = n AND kind = 'activation'""",
)
def dependency_focus(spark, sf_dir):
    edges = C.requirement_edges(rules(spark, sf_dir)).filter("kind = 'activation'")
    last = edges.filter("module_code = 'M1'").agg(F.max("target")).first()[0]
    places = derived(spark, sf_dir).select(F.col("activity_code").alias("node"), code_of(F.col("activity_code"), "objective").alias("objective")).distinct()
    order = spark.createDataFrame([("M1O01", "M1O02")], "source string, target string")  # the second objective needs the first
    return G.focus(edges.select("source", "target").unionByName(order), last, places)


@register("supported_modules", CATALOG_SQL + " SELECT DISTINCT module_code, CAST(regexp_extract(module_code, '([0-9]+)', 1) AS INTEGER) AS number FROM catalog")
def supported_modules(spark, sf_dir):
    return C.supported_modules(rules(spark, sf_dir), derived(spark, sf_dir), attempts(spark, sf_dir))
