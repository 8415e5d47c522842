"""Connected components of an edge table: union-find in tasks, star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition: each vertex with its smallest root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    vertices = list(parent)
    roots = [find(v) for v in vertices]
    for i in range(0, len(vertices), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(vertices[i : i + 50_000], pa.int64()), pa.array(roots[i : i + 50_000], pa.int64())], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect every vertex's (larger or smaller) neighbours to its smallest neighbour.

    The smallest neighbour per vertex is an aggregate with map-side combine; it is
    written, so the join back is between two plain exchanges and adaptive execution
    can split a vertex with very many neighbours.
    """
    if large:
        links = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    else:
        links = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w"))
    lowest = materialize(links.groupBy("v").agg(F.min("w").alias("m")).withColumn("m", F.least("v", "m")), "star-min")
    joined = links.join(lowest, "v")
    if large:
        out = joined.filter("w > v").select(F.col("w").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter("w <> m").select(F.col("w").alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b")


def _finished(edges: DataFrame) -> bool:
    """Every vertex has one edge and no root has an edge of its own."""
    ends = edges.select("a", F.lit(1).alias("out")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("out")).distinct())
    worst = ends.groupBy("a").agg(F.sum("out").alias("out"), F.count("*").alias("n")).agg(F.max(F.greatest("out", "n"))).first()[0]
    return (worst or 0) <= 1


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b); isolated ids are absent.

    Each round contracts the edges inside every partition by union-find, then links
    neighbourhoods to their minima across partitions; rounds grow with the logarithm of
    the longest chain.  One number per round returns to the driver.  Null ids and loops
    are no edges; an empty table gives an empty table.
    """
    pairs = edges.filter("a <> b").select("a", "b")
    now = materialize(pairs.mapInArrow(_contract, "a bigint, b bigint"), "edges")
    while not _finished(now):
        large = materialize(_star(now, True).mapInArrow(_contract, "a bigint, b bigint"), "star-large")
        small = materialize(_star(large, False).distinct(), "star-small")
        discard(now, large)
        now = small
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
