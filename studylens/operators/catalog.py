"""Curriculum catalogs: derived from attempts, loaded from JSON, flattened and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.columns import code_of, real_id, real_text

_ACTIVITY = T.StructType([T.StructField("id", T.StringType()), T.StructField("code", T.StringType()), T.StructField("title", T.StructType([T.StructField("short", T.StringType()), T.StructField("long", T.StringType())])), T.StructField("exercise_ids", T.ArrayType(T.StringType()))])
_OBJECTIVE = T.StructType([*_ACTIVITY.fields[:3], T.StructField("activities", T.ArrayType(_ACTIVITY))])
_MODULE = T.StructType([*_ACTIVITY.fields[:3], T.StructField("objectives", T.ArrayType(_OBJECTIVE))])
_ENTRY = T.StructType([T.StructField(c, T.StringType()) for c in ("type", "code", "short_title", "long_title")] + [T.StructField("sources", T.ArrayType(T.StringType()))])
_PLACE = T.StructType([T.StructField(c, T.StringType()) for c in ("activity_id", "objective_id", "module_id")])
CATALOG = T.StructType(
    [
        T.StructField("modules", T.ArrayType(_MODULE)),
        T.StructField("id_label_index", T.MapType(T.StringType(), _ENTRY)),
        T.StructField("exercise_to_hierarchy", T.MapType(T.StringType(), _PLACE)),
        T.StructField("conflicts", T.ArrayType(T.StringType())),
        T.StructField("orphans", T.ArrayType(T.StringType())),
    ]
)
RULES = T.StructType(
    [
        T.StructField("map_id_code", T.StructType([T.StructField("code_to_id", T.MapType(T.StringType(), T.StringType())), T.StructField("id_to_codes", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])),
        T.StructField("module_rules", T.ArrayType(T.StructType([T.StructField("module_code", T.StringType()), T.StructField("node_code", T.StringType()), T.StructField("requirements", T.StringType()), T.StructField("deact_requirements", T.StringType()), T.StructField("init_open", T.BooleanType())]))),
    ]
)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: the catalog file as one nested row with a declared schema."""
    return spark.read.schema(CATALOG).option("multiLine", True).json(path)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULES).option("multiLine", True).json(path)


def _title(c: str):
    return F.coalesce(real_text(F.col(f"{c}.title.short")), real_text(F.col(f"{c}.title.long")), F.col(f"{c}.code"))


def hierarchy(catalog: DataFrame) -> DataFrame:
    """SRC-2: module, objective, activity and exercise of every place, with orders and labels.

    Entries without id drop out; blank exercise ids drop out; empty activities stay with a
    NULL exercise.
    """
    m = catalog.select(F.posexplode("modules").alias("module_order", "m")).filter("m.id is not null")
    o = m.select("*", F.posexplode_outer("m.objectives").alias("objective_order", "o")).filter("o.id is not null")
    a = o.select("*", F.posexplode_outer("o.activities").alias("activity_order", "a")).filter("a.id is not null")
    e = a.select("*", F.explode_outer(F.filter("a.exercise_ids", lambda x: F.trim(x) != "")).alias("exercise_id"))
    return e.select(
        "module_order", "objective_order", "activity_order", F.col("m.id").alias("module_id"), F.col("m.code").alias("module_code"), _title("m").alias("module_label"),
        F.col("o.id").alias("objective_id"), F.col("o.code").alias("objective_code"), _title("o").alias("objective_label"),
        F.col("a.id").alias("activity_id"), F.col("a.code").alias("activity_code"), _title("a").alias("activity_label"), "exercise_id",
    )


def frames(catalog: DataFrame) -> dict[str, DataFrame]:
    """SRC-2: the normalised frames of a catalog."""
    full = hierarchy(catalog)
    pick = lambda *names: full.select(*names).distinct()
    places = catalog.select(F.explode("exercise_to_hierarchy").alias("exercise_id", "p")).select("exercise_id", "p.activity_id", "p.objective_id", "p.module_id").filter(real_text(F.col("exercise_id")).isNotNull())
    return {
        "modules": pick("module_id", "module_code", "module_label"),
        "objectives": pick("objective_id", "objective_code", "objective_label"),
        "activities": pick("activity_id", "activity_code", "activity_label"),
        "module_objectives": pick("module_id", "objective_id", "objective_order"),
        "objective_activities": pick("objective_id", "activity_id", "activity_order"),
        "activity_exercises": pick("activity_id", "exercise_id").filter("exercise_id is not null"),
        "activity_hierarchy": pick("module_id", "module_code", "module_label", "objective_id", "objective_label", "activity_id", "activity_label"),
        "exercise_hierarchy": places,
    }


def label_index(catalog: DataFrame) -> DataFrame:
    """SRC-3: id, type, code and label = short title, else long title, else code."""
    rows = catalog.select(F.explode("id_label_index").alias("id", "x"))
    return rows.select("id", F.col("x.type").alias("type"), F.col("x.code").alias("code"), F.coalesce(real_text(F.col("x.short_title")), real_text(F.col("x.long_title")), F.col("x.code")).alias("label"))


def preferred_codes(rules: DataFrame) -> DataFrame:
    """JN-3: one code per id: activity before objective before module, longer first, then alphabetical."""
    rows = rules.select(F.explode("map_id_code.id_to_codes").alias("id", "codes")).select("id", F.explode("codes").alias("code"))
    level = F.when(code_of(F.col("code"), "activity") == F.col("code"), 0).when(code_of(F.col("code"), "objective") == F.col("code"), 1).when(code_of(F.col("code"), "module") == F.col("code"), 2).otherwise(3)
    w = Window.partitionBy("id").orderBy("level", F.desc(F.length("code")), "code")
    return rows.withColumn("level", level).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("id", "code")


def code_fallbacks(rules: DataFrame, index: DataFrame, level: str) -> DataFrame:
    """JN-4: code -> (id, label) of one level."""
    rows = rules.select(F.explode("map_id_code.code_to_id").alias("code", "id")).filter(code_of(F.col("code"), level) == F.col("code"))
    return rows.join(index.select("id", "label"), "id", "left").dropDuplicates(["code"])


def exercise_map(frame: DataFrame, index: DataFrame) -> DataFrame:
    """JN-2: exercise -> hierarchy ids with labels, one row per exercise."""
    out = frame.withColumn("_r", F.row_number().over(Window.partitionBy("exercise_id").orderBy(*[F.coalesce(c, F.lit("")) for c in ("module_id", "objective_id", "activity_id")]))).filter("_r = 1").drop("_r")
    for level in ("activity", "objective", "module"):
        names = index.filter(F.col("type") == level).select(F.col("id").alias(f"{level}_id"), F.col("code").alias(f"{level}_code"), F.col("label").alias(f"{level}_label"))
        out = out.join(names, f"{level}_id", "left")
    return out


def derive_catalog(attempts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """SRC-7: hierarchy from attempts, ordered by first time seen, with synthetic codes.

    Codes read M1O01A01; labels of ``labels`` (id, label) win over those of the attempts.
    """
    seen = attempts.filter("exercise_id is not null and activity_id is not null and objective_id is not null")
    places = seen.groupBy("module_id", "module_code", "objective_id", "activity_id", "exercise_id").agg(F.min("created_at").alias("at"), F.min("module_label").alias("module_label"), F.min("objective_label").alias("objective_label"), F.min("activity_label").alias("activity_label"))
    module, objective = Window.partitionBy("module_id"), Window.partitionBy("module_id", "objective_id")
    rows = places.withColumns({"_o": F.min("at").over(objective), "_a": F.min("at").over(Window.partitionBy("module_id", "objective_id", "activity_id"))})
    rows = rows.withColumn("objective_order", F.dense_rank().over(module.orderBy("_o", "objective_id"))).withColumn("activity_order", F.dense_rank().over(objective.orderBy("_a", "activity_id")))
    pad = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    rows = rows.withColumns({"objective_code": F.concat("module_code", F.lit("O"), pad("objective_order"))}).withColumn("activity_code", F.concat("objective_code", F.lit("A"), pad("activity_order")))
    if labels is not None:
        for level in ("module", "objective", "activity"):
            named = labels.select(F.col("id").alias(f"{level}_id"), F.col("label").alias("_named"))
            rows = rows.join(named, f"{level}_id", "left").withColumn(f"{level}_label", F.coalesce("_named", f"{level}_label")).drop("_named")
    return rows.drop("at", "_o", "_a")


def catalog_totals(catalog: DataFrame, level: str) -> DataFrame:
    """AGG-18: exercises per exercise, activity, objective or module of a hierarchy table."""
    id_ = {"exercise": "exercise_id", "activity": "activity_id", "objective": "objective_id", "module": "module_code"}[level]
    label = "exercise_id" if level == "exercise" else f"{level}_label"
    return catalog.filter("exercise_id is not null").groupBy(F.col(id_).alias("id")).agg(F.max(label).alias("label"), F.count_distinct("exercise_id").alias("exercises"))


def synthesise_unmapped(attempts: DataFrame, catalog: DataFrame) -> DataFrame:
    """SRC-8: objectives of attempts that the catalog lacks, with the next free code numbers.

    Ids are taken in sorted order after the largest number in use below the module.
    """
    known = catalog.select("objective_id").distinct()
    missing = attempts.filter("objective_id is not null").select("module_code", "objective_id").distinct().join(known, "objective_id", "left_anti")
    used = catalog.groupBy("module_code").agg(F.max(F.regexp_extract("objective_code", r"O(\d+)$", 1).cast("int")).alias("used"))
    k = F.row_number().over(Window.partitionBy("module_code").orderBy("objective_id"))
    return missing.withColumn("k", k).join(used, "module_code", "left").select("module_code", "objective_id", F.concat("module_code", F.lit("O"), (F.coalesce("used", F.lit(0)) + F.col("k")).cast("string")).alias("objective_code"))


_PLACE_COLUMNS = [f"{level}_{c}" for level in ("module", "objective", "activity") for c in ("id", "code", "label")]
#: Which raw id is looked up as what: slot, kind of key, column.
_LOOKUPS = (
    ("as_module", "module", "playlist_or_module_id"), ("code_p", "graph", "playlist_or_module_id"), ("code_o", "graph", "objective_id"), ("code_a", "graph", "activity_id"),
    ("as_objective", "objective", "objective_id"), ("as_activity", "activity", "activity_id"), ("as_exercise", "exercise", "exercise_id"),
)


def place_dimension(catalog: DataFrame, codes: DataFrame) -> DataFrame:
    """JN-1: one row per (kind, key) with all that a raw id can tell about a place.

    Kinds: a module, objective or activity id, an exercise id, and a graph id of
    ``codes``, whose code is resolved to places here already; ``parts`` are the code's
    levels, also where the catalog lacks them.
    """
    least = lambda c: F.min(c).alias(c)
    of = {level: catalog.groupBy(F.col(f"{level}_code").alias("k")).agg(F.min(f"{level}_id").alias("id"), F.min(f"{level}_label").alias("label")) for level in ("module", "objective", "activity")}
    graph = codes.filter("code is not null").select(F.col("id").alias("key"), "code")
    for level, table in of.items():
        graph = graph.withColumn(f"{level}_part", code_of(F.col("code"), level))
        found = table.select(F.col("k").alias(f"{level}_part"), F.col("k").alias(f"{level}_code"), F.col("id").alias(f"{level}_id"), F.col("label").alias(f"{level}_label"))
        graph = graph.join(found, f"{level}_part", "left")
    ids = {
        "module": catalog.groupBy(F.col("module_id").alias("key")).agg(least("module_code"), least("module_label")).withColumn("module_id", F.col("key")),
        "objective": catalog.groupBy(F.col("objective_id").alias("key")).agg(least("objective_label")),
        "activity": catalog.groupBy(F.col("activity_id").alias("key")).agg(least("activity_label")),
        "exercise": catalog.groupBy(F.col("exercise_id").alias("key")).agg(F.min(F.struct("module_code", "objective_code", "activity_code", *[c for c in _PLACE_COLUMNS if not c.endswith("_code")])).alias("p")).select("key", "p.*"),
    }

    def rows(df: DataFrame, kind: str) -> DataFrame:
        text = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
        parts = F.struct(F.lit(kind == "graph").alias("coded"), *[text(f"{x}_part").alias(x) for x in ("module", "objective", "activity")]).alias("parts")
        return df.filter("key is not null").select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), F.struct(*[text(c).alias(c) for c in _PLACE_COLUMNS], parts).alias("place"))

    out = rows(graph, "graph")
    for kind, df in ids.items():
        out = out.unionByName(rows(df, kind))
    return out


def resolve(attempts: DataFrame, catalog: DataFrame, codes: DataFrame) -> DataFrame:
    """JN-1: hierarchy of every attempt from raw ids, graph codes or the exercise map.

    Module: direct id; else the code of the playlist, objective or activity; else, only if
    objective and activity are both missing, the exercise.  Objective and activity: raw
    ids always stay, labels come from the catalog; without a raw id the context code
    decides, else the exercise.  ``codes`` maps graph ids to one code each.  Emits one
    resolution source per level.

    Attempts are read twice: for their distinct contexts (four raw ids), which are
    resolved by one look-up in ``place_dimension`` each, and to be joined with what
    their context resolved to.  Every join is planned by the size of its sides.
    """
    raw = ("playlist_or_module_id", "objective_id", "activity_id", "exercise_id")
    keys = [f"_{c}" for c in raw]
    clean = [real_id(F.col(c)).alias(f"_{c}") for c in raw]
    contexts = attempts.select(*clean).distinct()
    asked = F.explode(F.array(*[F.struct(F.lit(slot).alias("slot"), F.lit(kind).alias("kind"), F.col(f"_{c}").alias("key")) for slot, kind, c in _LOOKUPS])).alias("q")
    found = contexts.select(*keys, asked).select(*keys, "q.*").join(place_dimension(catalog, codes), ["kind", "key"], "left")
    at = found.groupBy(*keys).agg(*[F.max(F.when(F.col("slot") == slot, F.col("place"))).alias(slot) for slot, _, _ in _LOOKUPS])

    by_code = F.coalesce(*[F.when(F.col(f"code_{x}.parts.coded"), F.col(f"code_{x}")) for x in "poa"])
    coded = {"module": by_code} | {level: F.coalesce(*[F.when(F.col(f"code_{x}.parts.{level}").isNotNull(), F.col(f"code_{x}")) for x in "aop"]) for level in ("objective", "activity")}
    bare = F.col("_objective_id").isNull() & F.col("_activity_id").isNull()
    fallback, direct = F.when(bare, F.col("as_exercise")), F.col("as_module")
    source = F.when(direct["module_id"].isNotNull(), "direct").when(coded["module"]["module_id"].isNotNull(), "context").when(fallback["module_id"].isNotNull(), "exercise").otherwise("missing")

    def level_columns(level: str) -> list[Column]:
        known, own, has = coded[level], F.col(f"as_{level}")[f"{level}_label"], F.col(f"_{level}_id").isNotNull()
        e = F.col("as_exercise")
        return [
            F.coalesce(f"_{level}_id", known[f"{level}_id"], e[f"{level}_id"]).alias(f"{level}_id"),
            F.when(has, own).otherwise(F.coalesce(known[f"{level}_label"], e[f"{level}_label"])).alias(f"{level}_label"),
            F.when(has & own.isNotNull(), "direct").when(has, "raw_id").when(known[f"{level}_id"].isNotNull(), "context").when(e[f"{level}_id"].isNotNull(), "exercise").otherwise("missing").alias(f"resolution_source_{level}"),
        ]

    module = [F.coalesce(direct[c], coded["module"][c], fallback[c]).alias(c) for c in ("module_id", "module_code", "module_label")]
    resolved = at.select(*keys, *module, source.alias("resolution_source_module"), *level_columns("objective"), *level_columns("activity"))

    placed = ("module_id", "module_code", "module_label", "objective_id", "objective_label", "activity_id", "activity_label")
    others = [c for c in attempts.columns if c not in placed]
    rows = attempts.select(*[real_id(F.col(c)).alias(c) if c in raw else F.col(c) for c in others], *[real_id(F.col(c)).alias(f"raw_{c}") for c in ("objective_id", "activity_id")])
    on = [F.col({"objective_id": "raw_objective_id", "activity_id": "raw_activity_id"}.get(c, c)).eqNullSafe(F.col(f"_{c}")) for c in raw]
    return rows.join(resolved, on).select(*others, *placed, *SOURCES)


SOURCES = tuple(f"resolution_source_{x}" for x in ("module", "objective", "activity"))


def context_lookup(fact: DataFrame) -> DataFrame:
    """AGG-8: resolved contexts with attempts and students."""
    keys = ["playlist_or_module_id", "module_id", "module_code", "module_label", "objective_id", "objective_label", "activity_id", "activity_label", "exercise_id", *[f"resolution_source_{x}" for x in ("module", "objective", "activity")]]
    return fact.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_distinct("user_id").alias("unique_students"))


def resolution_report(fact: DataFrame) -> DataFrame:
    """AGG-9: attempts by level and source."""
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"resolution_source_{x}").alias("source")) for x in ("module", "objective", "activity")])).alias("p")
    return fact.select(pairs, "exercise_id").groupBy("p.level", "p.source").agg(F.count("*").alias("attempts"), F.count_distinct("exercise_id").alias("exercises"))


def multi_context_exercises(fact: DataFrame) -> DataFrame:
    """AGG-9: exercises seen in more than one raw context."""
    return fact.filter("exercise_id is not null").groupBy("exercise_id").agg(F.count_distinct(F.struct("module_id", "objective_id", "activity_id")).alias("contexts")).filter("contexts > 1")


def requirement_edges(rules: DataFrame) -> DataFrame:
    """PRG-9, PRG-10: dependency edges from requirement texts such as ``M1O2A3(75%) M1O1``."""

    def parse(column: str, kind: str) -> DataFrame:
        tokens = F.explode(F.expr(f"regexp_extract_all({column}, '(M\\\\d+(?:O\\\\d+)?(?:A\\\\d+)?(?:\\\\(\\\\d+%?\\\\))?)', 1)")).alias("token")
        rows = rules.select(F.explode("module_rules").alias("r")).select("r.module_code", F.col("r.node_code").alias("target"), F.col(f"r.{column}").alias(column))
        return rows.select("module_code", "target", tokens).select("module_code", F.regexp_extract("token", r"^([^(]+)", 1).alias("source"), "target", F.lit(kind).alias("kind"), F.regexp_extract("token", r"\((\d+)", 1).try_cast("int").alias("threshold"))

    both = parse("requirements", "activation").unionByName(parse("deact_requirements", "deactivation"))
    return both.filter("source <> target").dropDuplicates(["module_code", "source", "target", "kind"])


def dependency_nodes(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """PRG-9: nodes of rules and edges; those without a rule are ghosts, those without need open."""
    ruled = rules.select(F.explode("module_rules").alias("r")).select("r.module_code", F.col("r.node_code").alias("node"), F.col("r.init_open").alias("declared"))
    ends = edges.select("module_code", F.explode(F.array("source", "target")).alias("node")).distinct()
    needed = edges.filter("kind = 'activation'").select("module_code", F.col("target").alias("node")).distinct().withColumn("needed", F.lit(True))
    full = ruled.withColumn("ruled", F.lit(True)).join(ends, ["module_code", "node"], "full").join(needed, ["module_code", "node"], "left")
    return full.select("module_code", "node", F.coalesce("declared", F.col("needed").isNull()).alias("init_open"), F.col("ruled").isNull().alias("ghost"))


def supported_modules(rules: DataFrame, catalog: DataFrame, attempts: DataFrame) -> DataFrame:
    """PRG-14: modules with rules, in the catalog and observed, in numeric order."""
    out = rules.select(F.explode("module_rules").alias("r")).select("r.module_code").distinct()
    for other in (catalog, attempts):
        out = out.join(other.select("module_code").distinct(), "module_code", "left_semi")
    return out.withColumn("number", F.regexp_extract("module_code", r"(\d+)", 1).cast("int")).orderBy("number", "module_code")
