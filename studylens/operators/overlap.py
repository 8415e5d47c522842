"""How many entities two items share, as a blocked sparse product of the entity x item matrix.

Items of a scope are dealt into blocks of about BLOCK by hash.  A row of the matrix, one
entity in one scope, becomes lists of its items by block; two lists of one entity meet,
not two items.  Tasks sort the meetings by block pair and add them up in one small
matrix at a time, so an entity with n items sends about (n / BLOCK)^2 / 2 rows of two
lists, and a block pair gives at most BLOCK^2 counts a task, however many entities it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Items of a block.
BLOCK = 256


class _Tally:
    """Counts of one block pair."""

    def __init__(self, same: bool):
        self.same = same
        self.names: tuple[dict[str, int], dict[str, int]] = ({}, {})
        if same:
            self.names = (self.names[0], self.names[0])
        self.counts = np.zeros((64, 64), dtype=np.int64)

    def add(self, left: list[str], right: list[str]) -> None:
        at = [np.array([names.setdefault(x, len(names)) for x in xs], dtype=np.int64) for names, xs in zip(self.names, (left, right))]
        need = max(len(names) for names in self.names)
        if need > len(self.counts):
            grown = np.zeros((2 * need, 2 * need), dtype=np.int64)
            grown[: len(self.counts), : len(self.counts)] = self.counts
            self.counts = grown
        self.counts[np.ix_(*at)] += 1  # an entity has an item once

    def rows(self) -> tuple[list[str], list[str], np.ndarray]:
        i, j = np.nonzero(self.counts)
        lefts, rights = (list(names) for names in self.names)
        found = [(lefts[a], rights[b], k) for a, b, k in zip(i.tolist(), j.tolist(), self.counts[i, j].tolist()) if not self.same or lefts[a] < rights[b]]
        ordered = [(a, b, k) if a < b else (b, a, k) for a, b, k in found]
        return [a for a, _, _ in ordered], [b for _, b, _ in ordered], np.array([k for _, _, k in ordered], dtype=np.int64)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted meetings (scope, i, j, xs, ys) to counts of this task."""
    key, tally = None, None

    def out():
        left, right, counts = tally.rows()
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(left), pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(counts)], names=["scope", "left", "right", "k"])

    for batch in batches:
        scopes, i, j, xs, ys = (batch.column(c).to_pylist() for c in ("scope", "i", "j", "xs", "ys"))
        for now, left, right in zip(zip(scopes, i, j), xs, ys):
            if now != key:
                if tally is not None:
                    yield out()
                key, tally = now, _Tally(now[1] == now[2])
            tally.add(left, right)
    if tally is not None:
        yield out()


def shared_counts(rows: DataFrame, entity: str, scope: str, item: str, block: int = BLOCK) -> DataFrame:
    """``scope``, left, right, shared: pairs of items (left < right as text) that share entities in a scope.

    Rows repeat freely and count once; a NULL entity, scope or item shares nothing.
    """
    seen = rows.select(F.col(entity).cast("string").alias("who"), F.col(scope).cast("string").alias("scope"), F.col(item).cast("string").alias("x")).filter("who is not null and scope is not null and x is not null").distinct()
    sizes = seen.groupBy("scope").agg(F.ceil(F.count_distinct("x") / F.lit(block)).cast("int").alias("blocks"))
    lists = seen.join(sizes, "scope").groupBy("who", "scope", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("i")).agg(F.collect_list("x").alias("xs"))
    other = lists.select("who", "scope", F.col("i").alias("j"), F.col("xs").alias("ys"))
    meetings = lists.join(other, ["who", "scope"]).filter("i < j or (i = j and size(xs) > 1)").select("scope", "i", "j", "xs", "ys")
    counts = meetings.sortWithinPartitions("scope", "i", "j").mapInArrow(_products, "scope string, left string, right string, k bigint")
    return counts.groupBy(F.col("scope").alias(scope), "left", "right").agg(F.sum("k").alias("shared"))
