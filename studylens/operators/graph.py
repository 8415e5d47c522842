"""Components, cores, neighbourhoods and classes of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import kept


def components(edges: DataFrame) -> DataFrame:
    """IRT-4: (node, component) of undirected edges (a, b), component = smallest node.

    Alternating large and small stars; every round keeps edges to neighbourhood minima and
    is checkpointed.  One row per round (count and checksum) returns to the driver.
    """
    now = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == last or not mark[0]:
            break
        last = mark
        links = now.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(now.select(F.col("b").alias("v"), F.col("a").alias("w")))
        low = kept(links.groupBy("v").agg(F.min("w").alias("m")).withColumn("m", F.least("v", "m")))
        large = links.join(low, "v").filter("w > v").select(F.col("w").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w"))
        low = kept(small.groupBy("v").agg(F.min("w").alias("m")))
        now = kept(small.join(low, "v").filter("w <> m").select(F.col("w").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("v").alias("a"), F.col("m").alias("b"))).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def component_sizes(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sizes of all components; nodes without edges are components of one; NULL is no node."""
    full = nodes.select("node").filter("node is not null").distinct().join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return full.groupBy("component").agg(F.count("*").alias("size"))


def two_core(edges: DataFrame) -> DataFrame:
    """IRT-6: edges left after repeatedly removing nodes of degree below 2."""
    now = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = now.count()
    while size:
        degree = now.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").count().filter("count >= 2")
        left = now.join(degree.select(F.col("n").alias("a")), "a", "left_semi").join(degree.select(F.col("n").alias("b")), "b", "left_semi")
        now, before = kept(left.select("a", "b")), size
        size = now.count()
        if size == before:
            break
    return now


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """PRG-11: edges with both ends among ``nodes``."""
    keep = nodes.select("node").distinct()
    return edges.join(keep.withColumnRenamed("node", "source"), "source", "left_semi").join(keep.withColumnRenamed("node", "target"), "target", "left_semi").select(*edges.columns)


def focus(edges: DataFrame, node: str, objectives: DataFrame | None = None) -> DataFrame:
    """PRG-12: all ancestors of a node and its direct children, with their relation.

    ``objectives`` (node, objective) are the activities with their objectives: the focused
    activity and every activity among its ancestors pull in their objective, and its
    ancestors.  A walk ends when a round finds nothing new.
    """
    up = edges.select("source", "target")
    if objectives is not None:
        up = up.unionByName(objectives.filter("objective is not null").select(F.col("objective").alias("source"), F.col("node").alias("target")))
    up = kept(up.distinct())
    found = kept(up.filter(F.col("target") == node).select(F.col("source").alias("node")).distinct())
    frontier = found
    while not frontier.isEmpty():
        frontier = kept(up.join(frontier.withColumnRenamed("node", "target"), "target", "left_semi").select(F.col("source").alias("node")).distinct().join(found, "node", "left_anti"))
        found = kept(found.unionByName(frontier))
    children = edges.filter(F.col("source") == node).select(F.col("target").alias("node")).distinct()
    return found.withColumn("relation", F.lit("ancestor")).unionByName(children.withColumn("relation", F.lit("child")))


def cyclic_groups(edges: DataFrame, group: str) -> DataFrame:
    """Groups whose edges (source, target; no node lies in two groups) hold a ring.

    A round trims both ends: edges from a node that none enters or into a node that none
    leaves.  Then a node with one way out points past a neighbour that also has one way
    out, so what a round trims of a chain doubles and a chain of n nodes takes log2 n
    rounds; graphs that keep branching lose a layer at each end.  Pointing past a
    neighbour neither makes nor breaks rings.  Where nothing can be trimmed every node
    left can be left again, so each group left has a ring.
    """
    left = kept(edges.select(group, "source", "target").distinct())
    size = left.count()
    while size:
        entered, leaving = left.select(F.col("target").alias("source")).distinct(), left.select(F.col("source").alias("target")).distinct()
        trimmed = left.join(entered, "source", "left_semi").join(leaving, "target", "left_semi").select(group, "source", "target")
        ways = trimmed.groupBy("source").agg(F.count("*").alias("n"), F.min("target").alias("past"))
        single = ways.filter("n = 1").select(F.col("source").alias("target"), "past")
        past = F.when(F.col("n") == 1, F.col("past"))
        left = kept(trimmed.join(ways.select("source", "n"), "source").join(single, "target", "left").select(group, "source", F.coalesce(past, F.col("target")).alias("target")))
        now = left.count()
        if now == size:
            break
        size = now
    return left.select(group).distinct()


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """PRG-13: per module node and edge counts, components, roots, acyclicity and class.

    ``nodes`` has module_code, node; ``edges`` module_code, source, target.
    """
    key = lambda c: F.concat_ws("|", "module_code", c)
    keyed = edges.select(key("source").alias("source"), key("target").alias("target"), "module_code").distinct()
    cyclic = cyclic_groups(keyed, "module_code").withColumn("cyclic", F.lit(True))
    parts = components(keyed.select(F.col("source").alias("a"), F.col("target").alias("b")))
    named = nodes.select("module_code", key("node").alias("node")).distinct().join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    degree = keyed.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("out"))
    indegree = keyed.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("in"))
    full = named.join(degree, "node", "left").join(indegree, "node", "left")
    out = full.groupBy("module_code").agg(
        F.count("*").alias("nodes"), F.coalesce(F.sum("out"), F.lit(0)).alias("edges"), F.count_distinct("component").alias("components"),
        F.count_if(F.col("in").isNull()).alias("roots"), F.coalesce(F.max("out"), F.lit(0)).alias("max_out"), F.coalesce(F.max("in"), F.lit(0)).alias("max_in"),
    )
    kind = (
        F.when(F.col("cyclic"), "cyclic").when(F.col("components") > 1, "disconnected_dag")
        .when((F.col("max_out") <= 1) & (F.col("max_in") <= 1), "linear").when(F.col("max_in") <= 1, "tree").otherwise("general_dag")
    )
    return out.join(cyclic, "module_code", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False))).withColumn("topology", kind)
