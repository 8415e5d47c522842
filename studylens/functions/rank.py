"""Ranks over whole tables without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .lineage import kept


def rank_by_count(rows: DataFrame, count: str, *ties: str, name: str = "rank", within: list[str] | None = None) -> DataFrame:
    """Rank by falling count, then by ``ties``; also the number of ranked rows, ``<name>_n``.

    Rows are dealt by ranges of (within, count, ties), so entities of one frequent count
    spread over as many tasks as others; what is summed is one row per range and group.
    """
    keys = within or []
    sizes = rows.groupBy(*keys).agg(F.count("*").alias(f"{name}_n"))
    ranked = rank_by_range(rows, F.desc(count), *ties, name=name, within=keys)
    return ranked.join(sizes, keys) if keys else ranked.join(F.broadcast(sizes))


def rank_by_range(rows: DataFrame, *order, name: str = "rank", within: list[str] | None = None) -> DataFrame:
    """Row number in a total order (of each ``within`` group): ranges are ordered in parallel, one row per range and group is summed."""
    keys = within or []
    parts = kept(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_k"))
    scope = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    above = F.sum("_k").over(scope.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "_part", F.coalesce(above, F.lit(0)).alias("_above"))
    placed = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    at = offsets if keys else F.broadcast(offsets)  # without groups there is one row per range
    return placed.join(at, [*keys, "_part"]).withColumn(name, F.col("_above") + F.col("_r")).drop("_part", "_above", "_r")


def order_statistics(rows: DataFrame, value: str, ranks: set[int], weight: str | None = None, buckets: int = 1024) -> dict[int, float]:
    """Values at 0-based ``ranks`` in rising order of ``value`` (finite), each row counted ``weight`` times.

    Range refinement: the range that holds a rank is cut into equal buckets, an aggregate
    counts them, and the bucket that holds the rank is the next range, down to one
    value.  The driver sees at most ``buckets`` rows for each rank and round, rows never
    move.  ``rows`` are read once a round and should be stored.
    """
    v, k = F.col(value), F.col(weight) if weight else F.lit(1)
    found: dict[int, float] = {}
    low, high = rows.agg(F.min(v), F.max(v)).first()
    ranges = [(low, high, 0, sorted(ranks))] if ranks and low is not None else []
    while ranges:
        place = F.lit(None).cast("struct<r:int,b:bigint>")
        for r, (a, b, _, _) in enumerate(ranges):
            share = (v / 2 - a / 2) / (b / 2 - a / 2) if b / 2 > a / 2 else (v > a).cast("double")
            place = F.when(v.between(a, b), F.struct(F.lit(r).alias("r"), F.least(F.lit(buckets - 1).cast("bigint"), F.floor(share * buckets)).alias("b"))).otherwise(place)
        counted = rows.select(place.alias("p"), v.alias("v"), k.alias("k")).filter("p is not null").groupBy("p").agg(F.sum("k").alias("k"), F.min("v").alias("a"), F.max("v").alias("b"))
        held: dict[int, list] = {}
        for row in counted.collect():
            held.setdefault(row.p.r, []).append((row.a, row.b, row.k))
        following = []
        for r, (_, _, below, wanted) in enumerate(ranges):
            for a, b, n in sorted(held.get(r, [])):
                here = [x for x in wanted if below <= x < below + n]
                if here and a == b:
                    found |= dict.fromkeys(here, a)
                elif here:
                    following.append((a, b, below, here))
                below += n
        ranges = following
    return found


def decile_by_cutoffs(rank, n):
    """First i in 1..10 with rank <= max(1, ceil(n * i / 10))."""
    steps = F.sequence(F.lit(1), F.lit(10))
    return F.array_min(F.filter(steps, lambda i: rank <= F.greatest(F.lit(1), F.ceil(n * i / F.lit(10)))))


def decile_by_floor(rank, n):
    """floor((rank - 1) * 10 / n) + 1."""
    return (F.floor((rank - 1) * 10 / n) + 1).cast("int")
