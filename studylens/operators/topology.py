"""Stored dependency tables: reconciled with the catalog, and built from module configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.columns import trimmed

NODE = ["node_id", "node_type", "label", "objective_code", "activity_index", "init_open", "source_primary", "source_enrichment", "is_ghost"]
KEY = ["module_code", "node_code"]


def _text(c: str) -> Column:
    """Blank text and NULL are the same."""
    return F.nullif(trimmed(F.col(c).cast("string")), F.lit(""))


def catalog_nodes(catalog: DataFrame) -> DataFrame:
    """PRG-9: objectives and activities of a flat catalog as dependency nodes, one per module and code."""

    def level(name: str, index: Column) -> DataFrame:
        rows = catalog.select(
            "module_code", F.col(f"{name}_code").alias("node_code"), F.col(f"{name}_id").alias("node_id"), F.lit(name).alias("node_type"), F.coalesce(_text(f"{name}_label"), F.col(f"{name}_code")).alias("label"),
            "objective_code", index.alias("activity_index"), F.lit(False).alias("init_open"), F.lit("catalog").alias("source_primary"), F.lit("rules").alias("source_enrichment"), F.lit(False).alias("is_ghost"),
        )
        return rows.filter(_text("node_code").isNotNull()).groupBy(*KEY).agg(F.min(F.struct(*NODE)).alias("n")).select(*KEY, "n.*")

    number = F.regexp_extract("activity_code", r"A(\d+)$", 1).try_cast("int")
    return level("objective", F.lit(None).cast("int")).unionByName(level("activity", number))


def reconcile_nodes(catalog: DataFrame, stored: DataFrame) -> DataFrame:
    """PRG-9: stored dependency nodes with the catalog's ids, labels and objectives; ``status`` tells what happened.

    ``catalog`` is of ``catalog_nodes``, ``stored`` has the same columns.  The catalog
    decides what a node is, the stored node whether it is open from the start or a ghost,
    and, where not blank, its sources.  Nodes of the catalog alone are ``added``, stored
    ones it does not know stay as they are (``kept``), the others are ``corrected`` if
    id, label or objective differed and else ``confirmed``.  Of stored rows with one
    code the smallest counts.
    """
    ours = stored.filter(_text("node_code").isNotNull()).select("module_code", _text("node_code").alias("node_code"), *NODE).groupBy(*KEY).agg(F.min(F.struct(*NODE)).alias("s"))
    rows = catalog.select(*KEY, F.struct(*NODE).alias("c")).join(ours, KEY, "full")
    known, both = F.col("c").isNotNull(), F.col("c").isNotNull() & F.col("s").isNotNull()
    same = lambda name: _text(f"c.{name}").eqNullSafe(_text(f"s.{name}"))
    status = F.when(~known, "kept").when(~both, "added").when(same("node_id") & same("label") & same("objective_code"), "confirmed").otherwise("corrected")
    merged = {c: F.when(known, F.col(f"c.{c}")).otherwise(F.col(f"s.{c}")) for c in NODE}
    for c in ("init_open", "is_ghost"):
        merged[c] = F.when(both, F.coalesce(f"s.{c}", F.lit(False))).otherwise(merged[c])
    for c in ("source_primary", "source_enrichment"):
        merged[c] = F.when(both, F.coalesce(_text(f"s.{c}"), F.col(f"c.{c}"))).otherwise(merged[c])
    return rows.select(*KEY, *[v.alias(c) for c, v in merged.items()], status.alias("status"))


def reconcile_report(nodes: DataFrame) -> DataFrame:
    """PRG-9: reconciled nodes per module, by what happened to them."""
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    return nodes.groupBy("module_code").agg(F.count("*").alias("nodes"), *[one(s) for s in ("added", "corrected", "confirmed", "kept")], F.count_if("is_ghost").alias("ghosts"))


_CONDITION = T.StructType([T.StructField("sr", T.ArrayType(T.DoubleType())), T.StructField("lvl", T.ArrayType(T.IntegerType()))])
_ENTRY = T.StructType(
    [
        T.StructField("subgroups", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("init_ssb", T.StringType()),
        T.StructField("requirements", T.ArrayType(T.MapType(T.StringType(), T.MapType(T.StringType(), _CONDITION)))),
    ]
)
_CONFIG = T.StructType([T.StructField("config", T.StructType([T.StructField("ai", T.StructType([T.StructField("moduleConfig", T.MapType(T.StringType(), T.MapType(T.StringType(), _ENTRY)))]))]))])


def config_entries(spark: SparkSession, path: str) -> DataFrame:
    """PRG-10: module_id, entry_id, subgroup, initial, requirements of a configuration file, in the file's order.

    An entry belongs to a module (entry_id = module_id) or an objective.  ``initial`` are
    positions, also where the file nests them once more; requirements are (target,
    source, level, sr).
    """
    modules = spark.read.schema(_CONFIG).option("multiLine", "true").json(path).select(F.explode("config.ai.moduleConfig").alias("module_id", "entries"))
    rows = modules.select("module_id", F.explode("entries").alias("entry_id", "e"))
    each = lambda m: F.transform(F.map_entries(m["value"]), lambda s: F.struct(m["key"].alias("target"), s["key"].alias("source"), F.get(s["value"]["lvl"], F.lit(0)).alias("level"), F.get(s["value"]["sr"], F.lit(0)).alias("sr")))
    asked = F.flatten(F.transform(F.map_entries(F.get("e.requirements", F.lit(0))), each))
    return rows.select("module_id", "entry_id", F.get("e.subgroups", F.lit(0)).alias("subgroup"), F.expr(r"cast(regexp_extract_all(e.init_ssb, '-?\\d+', 0) as array<int>)").alias("initial"), asked.alias("requirements"))


def _placed(owners: DataFrame, entries: DataFrame, members: DataFrame, member: str) -> DataFrame:
    """Members of every owner with their position: as the entry lists them, if it lists any, else in their own order.

    ``owners`` (module_id, owner), ``members`` (module_id, owner, <member>, code, own).  A member listed
    twice has both positions.
    """
    keys = ["module_id", "owner"]
    listed = owners.join(entries.withColumnRenamed("entry_id", "owner"), keys).select(*keys, F.posexplode("subgroup").alias("at", "_m")).withColumn(member, trimmed(F.col("_m"))).drop("_m")
    known = members.join(listed, [*keys, member])
    have = known.select(*keys).distinct()
    order = known.select(*keys, member, "code", "at").unionByName(members.join(have, keys, "left_anti").select(*keys, member, "code", F.col("own").alias("at")))
    return order.withColumn("position", (F.row_number().over(Window.partitionBy(*keys).orderBy("at", member)) - 1).cast("int")).drop("at")


def _orders(entries: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    objectives = catalog.filter("objective_id is not null and objective_code is not null").groupBy("module_id", "module_code", "objective_id").agg(F.min("objective_code").alias("code"), F.min("objective_order").alias("own"))
    activities = catalog.filter("objective_id is not null and activity_id is not null and activity_code is not null").groupBy("module_id", F.col("objective_id").alias("owner"), "activity_id").agg(F.min("activity_code").alias("code"), F.min("activity_order").alias("own"))
    configured = entries.filter("entry_id = module_id").select("module_id").distinct()
    objectives = objectives.join(configured, "module_id", "left_semi")
    placed = _placed(configured.withColumn("owner", F.col("module_id")), entries, objectives.select("module_id", F.col("module_id").alias("owner"), "objective_id", "code", "own"), "objective_id")
    inner = _placed(objectives.select("module_id", F.col("objective_id").alias("owner")), entries, activities.join(configured, "module_id", "left_semi"), "activity_id")
    codes = objectives.select("module_id", "module_code").distinct()
    return placed.drop("owner").join(codes, "module_id"), inner.withColumnRenamed("owner", "objective_id").join(codes, "module_id")


def configured_nodes(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """PRG-10: objectives and activities in configured order, with what is open from the start.

    An activity is open if its position is among the objective's initial ones and the
    objective is open itself; modules without an entry of their own have no nodes.
    """
    objectives, activities = _orders(entries, catalog)
    opened = entries.select("module_id", F.col("entry_id").alias("owner"), "initial")
    is_open = F.coalesce(F.array_contains("initial", F.col("position")), F.lit(False))
    top = objectives.join(opened.filter("owner = module_id").drop("owner"), "module_id", "left").withColumn("init_open", is_open).drop("initial")
    state = top.groupBy("module_id", "objective_id").agg(F.min("code").alias("objective_code"), F.max("init_open").alias("_open"))
    low = activities.join(opened.withColumnRenamed("owner", "objective_id"), ["module_id", "objective_id"], "left").join(state, ["module_id", "objective_id"]).withColumn("init_open", is_open & F.col("_open"))
    return top.select("module_code", F.col("objective_id").alias("node_id"), F.col("code").alias("node_code"), F.lit("objective").alias("node_type"), F.col("code").alias("objective_code"), "position", "init_open").unionByName(
        low.select("module_code", F.col("activity_id").alias("node_id"), F.col("code").alias("node_code"), F.lit("activity").alias("node_type"), "objective_code", "position", "init_open")
    )


def configured_edges(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """PRG-10: activation edges from nested requirements, levels joined to activities by position.

    A requirement names an objective and a level; its source is the activity at that
    position of the objective, or the objective where there is none.  Module entries
    aim at objectives and only tie objectives that are in order, objective entries aim at
    activities.  Of edges with the same ends the first stays: module entries by target
    and source order, then objective entries by objective and the file's order.
    """
    objectives, activities = _orders(entries, catalog)
    wanted = entries.select("module_id", "entry_id", F.posexplode("requirements").alias("nth", "r")).select("module_id", "entry_id", "nth", "r.*")
    first = lambda df, key: df.groupBy("module_id", key).agg(F.min("code").alias("code"), F.min("position").alias("position"))
    place = first(objectives, "objective_id")
    named = lambda prefix: place.select("module_id", F.col("objective_id").alias(prefix), F.col("code").alias(f"{prefix}_code"), F.col("position").alias(f"{prefix}_at"))
    of_modules = wanted.filter("entry_id = module_id").join(named("target"), ["module_id", "target"]).join(named("source"), ["module_id", "source"])
    of_modules = of_modules.select("module_id", "source", "level", "sr", "source_code", "target_code", F.struct(F.lit(0).alias("kind"), F.col("target_at").alias("a"), F.col("source_at").alias("b")).alias("turn"), F.lit("moduleConfig.requirements").alias("rule_text"))
    known = catalog.filter("activity_code is not null").groupBy("module_id", F.col("activity_id").alias("target")).agg(F.min("activity_code").alias("target_code"))
    every = catalog.filter("objective_code is not null").groupBy("module_id", F.col("objective_id").alias("source")).agg(F.min("objective_code").alias("source_code"))
    of_objectives = wanted.join(named("entry_id").drop("entry_id_code"), ["module_id", "entry_id"]).join(known, ["module_id", "target"]).join(every, ["module_id", "source"], "left")
    of_objectives = of_objectives.select("module_id", "source", "level", "sr", "source_code", "target_code", F.struct(F.lit(1).alias("kind"), F.col("entry_id_at").alias("a"), F.col("nth").alias("b")).alias("turn"), F.lit("moduleConfig.objective_requirements").alias("rule_text"))
    at_level = activities.select("module_id", F.col("objective_id").alias("source"), F.col("position").alias("level"), F.col("code").alias("level_code"))
    rows = of_modules.unionByName(of_objectives).join(at_level, ["module_id", "source", "level"], "left").withColumn("source_code", F.coalesce("level_code", "source_code")).filter("source_code is not null and target_code is not null")
    kept = rows.groupBy("module_id", "source_code", "target_code").agg(F.min_by(F.struct("level", "sr", "rule_text"), "turn").alias("e"))
    codes = objectives.select("module_id", "module_code").distinct()
    return kept.join(codes, "module_id").select(
        "module_code", F.lit("activation").alias("edge_type"), F.col("source_code").alias("from_node_code"), F.col("target_code").alias("to_node_code"),
        F.when(F.col("e.sr").isNotNull(), "success_rate").otherwise("unknown").alias("threshold_type"), F.col("e.sr").alias("threshold_value"), F.col("e.level").alias("enrich_lvl"), F.col("e.rule_text").alias("rule_text"),
    )
