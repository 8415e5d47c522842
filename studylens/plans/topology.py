"""Queries of stored and configured dependency tables.

The stored nodes and the configuration are made from the derived catalog by plain rules,
so that they grow with the attempts and SQL can say the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import stored
from ..operators import topology as T
from .progression import CATALOG_SQL, derived
from .registry import register


def _stored_nodes(nodes):
    """Catalog nodes as an older build may have left them: missing, renamed and ghost nodes."""
    i, objective = F.col("activity_index"), F.col("node_type") == "objective"
    old = nodes.filter(~F.coalesce(i == 2, F.lit(False))).withColumns(
        {
            "label": F.when(i == 1, F.concat("label", F.lit(" (old)"))).otherwise(F.col("label")),
            "node_id": F.when(objective & F.col("node_code").endswith("O02"), F.concat(F.lit("old-"), "node_id")).otherwise(F.col("node_id")),
            "init_open": objective & F.col("node_code").endswith("O01"),
            "source_primary": F.when(i == 3, " ").otherwise(F.lit("rules")),
        }
    )
    ghosts = nodes.select("module_code").distinct().withColumn("node_code", F.concat("module_code", F.lit("O99")))
    ghosts = ghosts.select("*", F.lit(None).cast("string").alias("node_id"), F.lit("objective").alias("node_type"), F.col("node_code").alias("label"), F.col("node_code").alias("objective_code"), F.lit(None).cast("int").alias("activity_index"), F.lit(False).alias("init_open"), F.lit("rules").alias("source_primary"), F.lit("").alias("source_enrichment"), F.lit(True).alias("is_ghost"))
    return old.unionByName(ghosts)


NODES_SQL = (
    CATALOG_SQL
    + """, catalog_nodes AS (
  SELECT module_code, objective_code AS node_code, min(objective_id) AS node_id, 'objective' AS node_type, min(objective_label) AS label, objective_code, CAST(NULL AS INTEGER) AS activity_index FROM catalog GROUP BY ALL
  UNION ALL
  SELECT module_code, activity_code, min(activity_id), 'activity', min(activity_label), objective_code, CAST(regexp_extract(activity_code, 'A([0-9]+)$', 1) AS INTEGER) FROM catalog GROUP BY ALL
), stored_nodes AS (
  SELECT module_code, node_code, CASE WHEN node_type = 'objective' AND node_code LIKE '%O02' THEN 'old-' || node_id ELSE node_id END AS node_id, node_type, CASE WHEN activity_index = 1 THEN label || ' (old)' ELSE label END AS label,
    objective_code, activity_index, node_type = 'objective' AND node_code LIKE '%O01' AS init_open, CASE WHEN activity_index = 3 THEN ' ' ELSE 'rules' END AS source_primary, 'rules' AS source_enrichment, false AS is_ghost
  FROM catalog_nodes WHERE activity_index IS DISTINCT FROM 2
  UNION ALL
  SELECT DISTINCT module_code, module_code || 'O99', NULL, 'objective', module_code || 'O99', module_code || 'O99', CAST(NULL AS INTEGER), false, 'rules', '', true FROM catalog_nodes
), reconciled AS (
  SELECT module_code, node_code, CASE WHEN c.node_type IS NOT NULL THEN c.node_id ELSE s.node_id END AS node_id, coalesce(c.node_type, s.node_type) AS node_type, coalesce(c.label, s.label) AS label,
    coalesce(c.objective_code, s.objective_code) AS objective_code, CASE WHEN c.node_type IS NOT NULL THEN c.activity_index ELSE s.activity_index END AS activity_index, coalesce(s.init_open, false) AS init_open,
    CASE WHEN c.node_type IS NULL THEN s.source_primary ELSE coalesce(nullif(trim(s.source_primary), ''), 'catalog') END AS source_primary,
    CASE WHEN c.node_type IS NULL THEN s.source_enrichment ELSE coalesce(nullif(trim(s.source_enrichment), ''), 'rules') END AS source_enrichment, coalesce(s.is_ghost, false) AS is_ghost,
    CASE WHEN c.node_type IS NULL THEN 'kept' WHEN s.node_type IS NULL THEN 'added'
         WHEN c.node_id IS NOT DISTINCT FROM s.node_id AND c.label = s.label AND c.objective_code = s.objective_code THEN 'confirmed' ELSE 'corrected' END AS status
  FROM catalog_nodes c FULL JOIN stored_nodes s USING (module_code, node_code)
)"""
)


def _reconciled(spark, sf_dir):
    nodes = T.catalog_nodes(stored(derived(spark, sf_dir), "catalog"))
    return T.reconcile_nodes(nodes, _stored_nodes(nodes))


@register("reconciled_nodes", NODES_SQL + " SELECT * FROM reconciled")
def reconciled_nodes(spark, sf_dir):
    return _reconciled(spark, sf_dir)


@register("reconcile_report", NODES_SQL + " SELECT module_code, count(*) AS nodes, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("added", "corrected", "confirmed", "kept")) + ", count(*) FILTER (WHERE is_ghost) AS ghosts FROM reconciled GROUP BY 1")
def reconcile_report(spark, sf_dir):
    return T.reconcile_report(_reconciled(spark, sf_dir))


def _configured(spark, sf_dir):
    """(entries, catalog): objectives in falling order, activities of even objectives too, requirements by level."""
    catalog = stored(derived(spark, sf_dir), "catalog")
    objectives = catalog.groupBy("module_id", "objective_id").agg(F.min("objective_order").alias("o"))
    activities = catalog.groupBy("module_id", "objective_id", "activity_id").agg(F.min("activity_order").alias("a"))
    before = objectives.select("module_id", F.col("objective_id").alias("source"), (F.col("o") + 1).alias("o"))
    need = lambda target, source, level, sr: F.struct(target.alias("target"), source.alias("source"), level.cast("int").alias("level"), sr.cast("double").alias("sr"))
    listed = lambda order, item: F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), item.alias("v")))), lambda x: x["v"])
    pairs = objectives.join(before, ["module_id", "o"], "left").withColumn("r", F.when(F.col("source").isNotNull(), need(F.col("objective_id"), F.col("source"), F.col("o") % 4, F.when(F.col("o") % 2 == 0, F.lit(0.75)))))
    of_modules = pairs.groupBy("module_id").agg(listed(-F.col("o"), F.col("objective_id")).alias("s"), F.collect_list("r").alias("requirements"))
    of_modules = of_modules.select("module_id", F.col("module_id").alias("entry_id"), F.concat(F.array(F.lit("nowhere")), "s").alias("subgroup"), F.array(F.lit(0)).alias("initial"), "requirements")
    rows = activities.join(objectives, ["module_id", "objective_id"])
    asks = F.when(F.col("a") >= 2, F.array(need(F.col("activity_id"), F.col("objective_id"), F.col("a") - 2, F.lit(0.6)), need(F.col("activity_id"), F.lit("nowhere"), F.lit(0), F.lit(0.1)))).otherwise(F.array().cast("array<struct<target:string,source:string,level:int,sr:double>>"))
    inner = rows.withColumn("r", asks).groupBy("module_id", "objective_id", "o").agg(listed(-F.col("a"), F.col("activity_id")).alias("s"), F.flatten(listed(F.col("a"), F.col("r"))).alias("requirements"))
    inner = inner.select("module_id", F.col("objective_id").alias("entry_id"), F.when(F.col("o") % 2 == 0, F.col("s")).alias("subgroup"), F.array(F.lit(0), F.lit(2)).alias("initial"), "requirements")
    return stored(of_modules.unionByName(inner), "entries"), catalog


CONFIG_SQL = (
    CATALOG_SQL
    + """, objs AS (SELECT module_id, min(module_code) AS module_code, objective_id, min(objective_code) AS code, min(objective_order) AS o FROM catalog GROUP BY module_id, objective_id),
acts AS (SELECT module_id, objective_id, activity_id, min(activity_code) AS code, min(activity_order) AS a FROM catalog GROUP BY module_id, objective_id, activity_id),
obj_place AS (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY o DESC) - 1 AS pos FROM objs),
act_place AS (SELECT c.*, j.module_code, j.code AS objective_code, j.pos AS above, row_number() OVER (PARTITION BY c.module_id, c.objective_id ORDER BY CASE WHEN j.o % 2 = 0 THEN -a ELSE a END) - 1 AS pos FROM acts c JOIN obj_place j USING (module_id, objective_id)),
config_needs AS (
  SELECT t.module_id, s.objective_id AS source, t.o % 4 AS level, CASE WHEN t.o % 2 = 0 THEN 0.75::DOUBLE END AS sr, t.code AS target_code, s.code AS source_code, 0 AS kind, t.pos AS turn, s.pos AS nth, 'moduleConfig.requirements' AS rule_text
  FROM obj_place t JOIN obj_place s ON s.module_id = t.module_id AND s.o = t.o - 1
  UNION ALL
  SELECT a.module_id, a.objective_id, a.a - 2, 0.6::DOUBLE, a.code, a.objective_code, 1, a.above, a.a, 'moduleConfig.objective_requirements' FROM act_place a WHERE a.a >= 2
), config_levels AS (
  SELECT n.*, coalesce(l.code, n.source_code) AS from_code FROM config_needs n LEFT JOIN act_place l ON l.module_id = n.module_id AND l.objective_id = n.source AND l.pos = n.level
), config_edges AS (SELECT * FROM config_levels QUALIFY row_number() OVER (PARTITION BY module_id, from_code, target_code ORDER BY kind, turn, nth) = 1)"""
)


@register(
    "configured_edges",
    CONFIG_SQL
    + """ SELECT (SELECT min(module_code) FROM objs o WHERE o.module_id = e.module_id) AS module_code, 'activation' AS edge_type, from_code AS from_node_code, target_code AS to_node_code,
  CASE WHEN sr IS NULL THEN 'unknown' ELSE 'success_rate' END AS threshold_type, sr AS threshold_value, CAST(level AS INTEGER) AS enrich_lvl, rule_text FROM config_edges e""",
)
def configured_edges(spark, sf_dir):
    return T.configured_edges(*_configured(spark, sf_dir))


@register(
    "configured_nodes",
    CONFIG_SQL
    + """ SELECT module_code, objective_id AS node_id, code AS node_code, 'objective' AS node_type, code AS objective_code, CAST(pos AS INTEGER) AS position, pos = 0 AS init_open FROM obj_place
UNION ALL SELECT module_code, activity_id, code, 'activity', objective_code, CAST(pos AS INTEGER), above = 0 AND pos IN (0, 2) FROM act_place""",
)
def configured_nodes(spark, sf_dir):
    return T.configured_nodes(*_configured(spark, sf_dir))
