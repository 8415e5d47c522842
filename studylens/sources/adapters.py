"""Adapters from module configurations to the common hierarchy, and the completion of attempts by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.columns import code_of, real_text
from ..operators.catalog import synthesise_unmapped

PLACE = ["module_id", "module_code", "module_label", "objective_id", "objective_code", "objective_label", "activity_id", "activity_code", "activity_label"]
_ENTRY = "struct<id:string,code:string,title:struct<short:string,long:string>,learning_items:array<string>>"
CONFIG = f"module map<string,{_ENTRY}>, objective map<string,{_ENTRY}>, activity map<string,{_ENTRY}>"


def config_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: (id, type, code, label, exercise_ids) of a configuration with one map per level."""
    raw, out = spark.read.schema(CONFIG).option("multiLine", True).json(path), None
    for level in ("module", "objective", "activity"):
        rows = raw.select(F.explode(F.map_values(level)).alias("x"))
        label = F.coalesce(real_text(F.col("x.title.short")), real_text(F.col("x.title.long")), F.col("x.code"))
        part = rows.select(F.trim("x.id").alias("id"), F.lit(level).alias("type"), F.trim("x.code").alias("code"), label.alias("label"), F.col("x.learning_items").alias("exercise_ids"))
        out = part if out is None else out.unionByName(part)
    return out.filter(real_text(F.col("id")).isNotNull() & real_text(F.col("code")).isNotNull())


def config_hierarchy(rows: DataFrame) -> DataFrame:
    """SRC-6, SRC-9: hierarchy of configuration rows (id, type, code, label, exercise_ids).

    Parents are found by code prefix; entries without parent drop out; an activity without
    exercises keeps one row with a NULL exercise.
    """
    level = lambda name: rows.filter(F.col("type") == name).select(F.col("id").alias(f"{name}_id"), F.col("code").alias(f"{name}_code"), F.col("label").alias(f"{name}_label"))
    listed = rows.filter("type = 'activity'").select(F.col("id").alias("activity_id"), F.filter("exercise_ids", lambda x: F.trim(x) != "").alias("_exercises"))
    objectives = level("objective").withColumn("module_code", code_of(F.col("objective_code"), "module")).join(level("module"), "module_code")
    activities = level("activity").withColumn("objective_code", code_of(F.col("activity_code"), "objective")).join(objectives, "objective_code").join(listed, "activity_id")
    return activities.select(*PLACE, F.explode_outer("_exercises").alias("exercise_id"))


def extended_catalog(attempts: DataFrame, catalog: DataFrame) -> DataFrame:
    """SRC-8: the hierarchy with what attempts add: objectives and activities that it lacks, and exercises seen.

    New codes are the next free numbers below their parent, ids in sorted order.  An
    unknown objective belongs to the module of its earliest attempt, an unknown activity
    to the objective of its earliest attempt; an activity without any stays unmapped.
    """
    known = catalog.select(*PLACE).distinct()
    parents = known.select(*PLACE[:6]).distinct()
    modules = known.select(*PLACE[:3]).distinct().dropDuplicates(["module_code"])
    first = lambda c, key: attempts.filter(F.col(c).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("created_at", c))[c].alias(c))
    owner = first("module_code", "objective_id")
    lost = attempts.select("objective_id").distinct().join(owner, "objective_id")
    added = synthesise_unmapped(lost, catalog).join(modules, "module_code").withColumn("objective_label", F.concat(F.lit("Unmapped objective "), F.substring("objective_id", 1, 8)))
    parents = parents.unionByName(added.select(*PLACE[:6]))
    new = first("objective_id", "activity_id").join(known.select("activity_id").distinct(), "activity_id", "left_anti").join(parents, "objective_id")
    used = known.groupBy("objective_code").agg(F.max(F.regexp_extract("activity_code", r"A(\d+)$", 1).try_cast("int")).alias("_used"))
    k = F.row_number().over(Window.partitionBy("objective_code").orderBy("activity_id"))
    new = new.withColumn("_k", k).join(used, "objective_code", "left").withColumns(
        {"activity_code": F.concat("objective_code", F.lit("A"), (F.coalesce("_used", F.lit(0)) + F.col("_k")).cast("string")), "activity_label": F.concat(F.lit("Unmapped activity "), F.substring("activity_id", 1, 8))}
    )
    places = known.unionByName(new.select(*PLACE))
    seen = attempts.filter("activity_id is not null and exercise_id is not null").select("activity_id", "exercise_id").distinct()
    pairs = catalog.filter("exercise_id is not null").select("activity_id", "exercise_id").unionByName(seen).distinct()
    return places.join(pairs, "activity_id", "left").select(*PLACE, "exercise_id")


def completed(attempts: DataFrame, catalog: DataFrame) -> DataFrame:
    """SRC-8: attempts with activity, objective and module from four lookups; unresolved rows stay.

    Raw activity and objective ids win, then the activity's objective, then the exercise.
    The module comes from the activity, the objective, the exercise, or a playlist id that
    is a module.
    """
    smallest = lambda key, *names: catalog.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*names)).alias("_p")).select("_key", *[F.col(f"_p.{n}").alias(f"_{key[0]}_{n}") for n in names])
    rows = attempts.drop("module_id")
    for key, names in (("activity_id", ("objective_id", "module_id")), ("objective_id", ("module_id",)), ("exercise_id", ("module_id", "objective_id", "activity_id"))):
        table = smallest(key, *names)
        rows = rows.join(table, F.col(key) == F.col("_key"), "left").drop("_key")
    modules = catalog.select(F.col("module_id").alias("_playlist_module")).distinct()
    rows = rows.join(modules, F.col("playlist_or_module_id") == F.col("_playlist_module"), "left")
    return rows.select(
        *[c for c in attempts.columns if c not in ("activity_id", "objective_id", "module_id")],
        F.coalesce("activity_id", "_e_activity_id").alias("activity_id"),
        F.coalesce("objective_id", "_a_objective_id", "_e_objective_id").alias("objective_id"),
        F.coalesce("_a_module_id", "_o_module_id", "_e_module_id", "_playlist_module").alias("module_id"),
    )


def one_module(attempts: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-9: (attempts with their module, hierarchy) of one module's configuration; without a module row the job fails.

    Attempts without playlist belong to the module.  Activities that the configuration
    lacks are listed by ``ingest.orphans``.
    """
    module = rows.filter("type = 'module'").agg(F.min(F.struct("id", "code", "label")).alias("m"))
    module = module.select(*[F.coalesce(F.col(f"m.{c}"), F.raise_error(F.lit("the configuration has no module row")).cast("string")).alias(f"_{c}") for c in ("id", "code", "label")])
    out = attempts.drop("module_id", "module_code", "module_label").join(F.broadcast(module))
    named = out.withColumns({"module_id": F.coalesce("playlist_or_module_id", "_id"), "module_code": F.col("_code"), "module_label": F.coalesce("module_long_title", "_label")})
    return named.drop("_id", "_code", "_label"), config_hierarchy(rows)
