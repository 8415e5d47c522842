"""Hard negatives for contrastive training, mined by threshold joins with a pruned inverted index.

Rows lie in blocks, anchors in groups, and every group meets every block once.  Inside a
meeting the block is indexed by strips of dimensions.  A row's last strips are left out
of the index where the norm of what they hold, times the anchor's, stays below every
threshold of the group: they alone cannot make a result.  An anchor then walks through
the strips, adds up partial scores, and drops a row as soon as its partial score plus
the product of both remaining norms falls below the threshold.  What is left is scored
exactly.

Positives come first, under a threshold that rises with the fifth best found.  Negatives
are found in rounds: the threshold starts just below the positive's score and is lowered
for those windows only that are not full, down to the floor that the rule names, so no
row of a window is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import discard, flat, materialize

#: Components of a block of rows and of a group of anchors; rows follow from it.
BLOCK_CELLS, GROUP_CELLS, BLOCK_ROWS = 1 << 17, 1 << 15, 2048
#: Dimensions between two prunings.
STRIP = 8
#: Thresholds of the rounds, in percent of the positive's score; the floor comes last.
STEPS = (95, 88)
#: Bounds are computed in floating point; they are widened by this share before they drop anything.
SLACK = 1e-9


class PrunedIndex:
    """Rows of a block by strips of dimensions, without the strips that suffix norms rule out."""

    def __init__(self, values: np.ndarray, least: float):
        """``least``: the smallest threshold of any anchor, divided by the anchor's norm."""
        real = values.astype(np.float64)
        n, dims = real.shape
        self.order = np.argsort(-(real**2).sum(axis=0), kind="stable")
        real = real[:, self.order]
        cuts = np.arange(0, dims, STRIP)
        squares = np.add.reduceat(real**2, cuts, axis=1) if dims else np.zeros((n, 0))
        norms = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])
        norms = np.concatenate([norms, np.zeros((n, 1))], axis=1)
        indexed = (norms[:, :-1] * (1 + SLACK) >= least).sum(axis=1) if least > 0 else np.full(n, len(cuts))
        self.rows = np.argsort(-indexed, kind="stable")
        self.norms, self.indexed, self.real = norms[self.rows], indexed[self.rows], real[self.rows]
        self.exact = values[self.rows][:, self.order]
        #: Rows that have postings in strip b are the first holders[b].
        self.holders = [int((self.indexed > b).sum()) for b in range(len(cuts))]
        self.reach = self.holders[0] if self.holders else (n if least <= 0 else 0)
        self.strips = [np.ascontiguousarray(self.real[:h, c : c + STRIP]) for h, c in zip(self.holders, cuts)]

    def search(self, anchor: np.ndarray, at: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """(places among ``at``, exact scores) of all rows that score ``threshold`` or more."""
        anchor = anchor[self.order]
        real = anchor.astype(np.float64)
        cuts = np.arange(0, len(real), STRIP)
        rest = np.append(np.sqrt(np.cumsum(np.add.reduceat(real**2, cuts)[::-1])[::-1]), 0.0) if len(real) else np.zeros(1)
        at = at[at < self.reach]
        least = threshold - SLACK * rest[0] * (self.norms[:, 0].max() if len(self.norms) else 0.0)
        part = np.zeros(len(at))
        for b, strip in enumerate(self.strips):
            live = int(np.searchsorted(at, self.holders[b]))
            if not live:
                break
            part[:live] += strip[at[:live]] @ real[b * STRIP : b * STRIP + STRIP]
            seen = np.minimum(self.indexed[at], b + 1)
            keep = part + rest[seen] * self.norms[at, seen] >= least
            at, part = at[keep], part[keep]
        scores = self._scores(anchor, real, rest[0], at)
        enough = scores >= threshold
        return at[enough], scores[enough]

    def _scores(self, anchor, real, norm, at) -> np.ndarray:
        if not len(at):
            return np.zeros(0, dtype=np.int64)
        if norm * self.norms[at, 0].max() < 2.0**52:  # every partial sum is a whole number below 2**53
            return (self.real[at] @ real).astype(np.int64)
        exact = self.exact[at].astype(object) @ anchor.astype(object)
        return np.array(exact.tolist(), dtype=np.int64)  # raises where a score is no long


def quantized(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256) -> DataFrame:
    """vec_id, label, q (floor(scale * component)) of the rows that take part.

    Rows with a null id, label or vector, or with a null or non-finite component, don't.
    """
    x, label = F.col(vector_col), F.col("label") if label is None else label
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"), F.coalesce(finite, F.lit(False)).alias("ok"))
    return rows.filter("ok and vec_id is not null and label is not null").select("vec_id", "label", F.transform("x", lambda c: F.floor(c.cast("double") * scale)).alias("q"))


_BLOCK = "block bigint, dims int, ids array<bigint>, labels array<bigint>, cells array<bigint>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one length together, as lists.  ``block`` numbers them within the task's partition."""
    made: dict[int, int] = {}
    for batch in batches:
        q = batch.column("q")
        sizes = np.diff(q.offsets.to_numpy()) if len(q) else np.zeros(0, dtype=np.int64)
        cells, starts = q.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))
        ids, labels, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "part"))
        out = []
        for dims in np.unique(sizes):
            mine = np.flatnonzero(sizes == dims)
            step = int(max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, dims))))
            for k in range(0, len(mine), step):
                rows = mine[k : k + step]
                number = made[int(part[0])] = made.get(int(part[0]), -1) + 1
                at = (starts[rows][:, None] + np.arange(dims)[None, :]).ravel()
                out.append((int(part[0]) << 32 | number, int(dims), ids[rows], labels[rows], cells[at]))
        if out:
            lists = [pa.array([o[i] for o in out], pa.list_(pa.int64())) for i in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), *lists], names=["block", "dims", "ids", "labels", "cells"])


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _fit(q: np.ndarray, dims: int) -> np.ndarray:
    """An anchor over a block's dimensions; what one of them lacks counts as zero."""
    out = np.zeros(dims, dtype=np.int64)
    out[: min(dims, len(q))] = q[:dims]
    return out


def _meetings(batches: Iterator[pa.RecordBatch]):
    """(cell, block, anchors) of every joined row."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            block = {c: flat(row, c) for c in ("ids", "labels", "cells")}
            dims = row.column("dims")[0].as_py()
            yield row.column("cell")[0].as_py(), block | {"values": block["cells"].reshape(len(block["ids"]), dims)}, row.column("anchors")[0].as_py()


def _ratio(q: np.ndarray, threshold: int) -> float:
    norm = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
    return threshold / norm if norm else (0.0 if threshold <= 0 else float("inf"))


_FOUND = "anchor bigint, place int, id bigint, score bigint"


def _emit(best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys = [(k, len(v[0])) for k, v in best.items()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat([k[0] for k, _ in keys], [n for _, n in keys]).astype(np.int64)),
            pa.array(np.repeat([k[1] for k, _ in keys], [n for _, n in keys]).astype(np.int32)),
            pa.array(np.concatenate([v[0] for v in best.values()] or [np.zeros(0)]).astype(np.int64)),
            pa.array(np.concatenate([v[1] for v in best.values()] or [np.zeros(0)]).astype(np.int64)),
        ],
        names=["anchor", "place", "id", "score"],
    )


def _mine(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Best ``k`` rows of every window of a cell's anchors; an anchor without windows looks for its positives.

    Blocks of one cell follow each other, so what they have found is kept until the cell ends.
    """
    best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    last = None
    for cell, block, anchors in _meetings(batches):
        if cell != last and best:
            yield _emit(best)
            best = {}
        last, work = cell, []
        for a in anchors:
            q = _fit(np.array(a["q"] or [], dtype=np.int64), block["values"].shape[1])
            if a["windows"] is None:  # below zero no positive has a window
                held = best.get((a["anchor"], 0))
                threshold = max(0, int(held[1][-1])) if held is not None and len(held[1]) == k else 0
            else:
                threshold = min(w["least"] for w in a["windows"])
            work.append((a, q, threshold))
        index = PrunedIndex(block["values"], min((_ratio(q, t) for _, q, t in work), default=0.0))
        ids, labels = block["ids"][index.rows], block["labels"][index.rows]
        for a, q, threshold in work:
            same = labels == a["label"]
            at = np.flatnonzero(same & (ids != a["vec_id"]) if a["windows"] is None else ~same)
            at, scores = index.search(q, at, threshold)
            for w in a["windows"] or [{"place": 0, "least": threshold, "most": None}]:
                fits = scores >= w["least"]
                if w["most"] is not None:
                    fits &= scores <= w["most"]
                if fits.any():
                    old = best.get((a["anchor"], w["place"]), (ids[:0], scores[:0]))
                    best[a["anchor"], w["place"]] = _top(np.append(old[0], ids[at[fits]]), np.append(old[1], scores[fits]), k)
    if best:
        yield _emit(best)


def _search(blocks: DataFrame, anchors: DataFrame, groups: int, shards: int, k: int, name: str) -> DataFrame:
    """The best ``k`` of every (anchor, place) over all blocks."""
    packed = anchors.groupBy("g").agg(F.collect_list(F.struct("anchor", "vec_id", "label", "q", "windows")).alias("anchors"))
    packed = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), "g", "anchors").select((F.col("s") * groups + F.col("g")).alias("cell"), "anchors")
    dealt = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    dealt = dealt.select((F.pmod(F.xxhash64("block"), F.lit(shards)) * groups + F.col("g")).alias("cell"), "dims", "ids", "labels", "cells")
    found = dealt.join(packed.hint("merge"), "cell").mapInArrow(lambda it: _mine(it, k), _FOUND)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return materialize(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), f"mine-{name}", batch_rows=4)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, floor_percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, q as of ``quantized``.  A score is the integer inner product;
    higher scores come first, ties by smaller vec_id.  An anchor's positives are its first
    ``positives`` rows of its label with another vec_id; for each, the first ``negatives``
    rows of other labels that score at most as high and at least ``floor_percent`` percent
    of it.  Positives that score below zero have no such rows.

    Every row counts, also repeated ones; an anchor that is repeated exactly is one
    anchor, anchors that only share their id are served one by one.  Vectors of unequal
    length meet as if the shorter one ended in zeros.  An empty table, or one without
    anchors, gives an empty table; scores beyond a long raise.

    Anchors are grouped by hash and blocks hold a bounded number of components, so
    neither a frequent label nor many copies of one vector fill a task; a task keeps the
    best few rows of each window of one group.
    """
    spark = rows.sparkSession
    k = max(positives, negatives)
    anchors = rows.filter(is_anchor).distinct().withColumn("anchor", F.monotonically_increasing_id())
    anchors = materialize(anchors, "mine-anchors")
    blocks = materialize(rows.withColumn("part", F.spark_partition_id()).mapInArrow(_blocks, _BLOCK), "mine-blocks", batch_rows=BLOCK_ROWS)
    cells, n_blocks = anchors.agg(F.sum(F.size("q"))).first()[0] or 0, blocks.count()
    groups = max(1, -(-cells // GROUP_CELLS))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, min(n_blocks, max(n_blocks // 8, 2 * partitions)))
    grouped = anchors.withColumn("g", F.pmod(F.xxhash64("anchor"), F.lit(groups)))

    kind = "array<struct<place:int,least:bigint,most:bigint>>"
    found = _search(blocks, grouped.withColumn("windows", F.lit(None).cast(kind)), groups, shards, k, "positives")
    ids = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    windows = found.filter(F.col("rank") <= positives).join(ids, "anchor")
    windows = materialize(windows.select("anchor", "anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "mine-windows")

    parts, still = [], windows
    steps = [*[s for s in STEPS if s > floor_percent], floor_percent]
    for percent in steps:
        least = F.expr(f"(positive_score div 100) * {percent} + (positive_score % 100 * {percent} + 99) div 100")  # rounded up, without overflow
        wanted = still.groupBy("anchor").agg(F.collect_list(F.struct("place", least.alias("least"), F.col("positive_score").alias("most"))).alias("windows"))
        found = _search(blocks, grouped.join(wanted, "anchor"), groups, shards, k, f"negatives-{percent}").filter(F.col("rank") <= negatives)
        if percent != steps[-1]:
            full = found.groupBy("anchor", "place").agg(F.count("*").alias("n")).filter(F.col("n") == negatives).select("anchor", "place")
            parts.append(found.join(full, ["anchor", "place"], "left_semi"))
            still = materialize(still.join(full, ["anchor", "place"], "left_anti"), f"mine-open-{percent}")
            if still.isEmpty():
                break
        else:
            parts.append(found)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.join(windows, ["anchor", "place"])
    out = materialize(out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mine-result")
    discard(anchors, blocks, windows)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh id are shifted; every hundredth id is an anchor."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    noisy = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(quantized(df, label=noisy), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(r.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5
"""
