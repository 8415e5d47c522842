"""Vector best-fit packing of token sequences.

Every piece of a document asks for a vector (tokens, documents, attention cost) and
every bin offers one.  Among the bins whose residual holds the piece in every
dimension, the one whose residual after placing has the smallest weighted norm wins
("norm", the rule in production) or the one with the largest weighted dot product of
demand and residual ("dot", which spreads pieces and needs more sequences).  Pieces go
in by falling length; equal bins by age.

All three demands follow from the length, so pieces of one length are alike and so are
bins of one content.  The plan is made on counts: at most ``capacity`` lengths, and
groups of alike bins instead of bins.  Its size depends on the number of distinct
lengths, not on the number of documents.  Spark counts the lengths, numbers the pieces
of each length, and looks every piece's place up in the plan.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import documents, materialize, texts

CAPACITY = 2048


@functools.cache
def _encoder(ranks_path: str, special: tuple[tuple[str, int], ...]):
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


_PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, chunk int, rank bigint"


def _cut(batches: Iterator[pa.RecordBatch], ranks_path: str, special: tuple, capacity: int) -> Iterator[pa.RecordBatch]:
    """Pieces with their rank among the pieces of the same length in this partition, the chunk.

    The first piece of a long document takes the remainder, so that all others are full.
    """
    coder = _encoder(ranks_path, special)
    allowed = {s for s, _ in special}
    seen = [0] * (capacity + 1)
    for batch in batches:
        chunk = batch.column("part")[0].as_py() if batch.num_rows else 0
        ids_of, piece, start, size, crc, rank = [], [], [], [], [], []
        for doc_id, data in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            text = data.decode()
            ids = coder.encode_to_numpy(text, allowed_special=allowed if any(s in text for s in allowed) else set(), disallowed_special=())
            ids = np.append(ids, 0).astype("<u4")
            at, n = 0, len(ids) % capacity or capacity
            k = 0
            while at < len(ids):
                ids_of.append(doc_id)
                piece.append(k)
                start.append(at)
                size.append(n)
                crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                rank.append(seen[n])
                seen[n] += 1
                at, n, k = at + n, capacity, k + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids_of, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(crc, pa.int64()), pa.array([chunk] * len(piece), pa.int32()), pa.array(rank, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "rank"],
        )


class VectorBestFit:
    """Plan for counted lengths: groups of alike bins, filled by falling length.

    ``plan`` places exactly what placing piece by piece would.  Under "norm" a bin that
    took a piece is nearer to full than its like, so the next piece of that length goes
    there too as long as it fits; under "dot" its product falls, so its like come first.
    """

    def __init__(self, capacity: int, max_docs: int | None = None, max_cost: float | None = None, weights=(1.0, 0.1, 0.1), rule: str = "norm"):
        if rule not in ("dot", "norm"):
            raise ValueError(f"unknown rule {rule!r}")
        self.limits = np.array([capacity, max_docs or capacity, max_cost or float(capacity) ** 2])
        self.weights, self.rule = np.asarray(weights, dtype=float), rule

    def demand(self, length: int) -> np.ndarray:
        return np.array([length, 1.0, float(length) ** 2])

    def score(self, residual: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Of bins that hold the piece; the lowest wins."""
        share, ask = residual / self.limits, need / self.limits
        if self.rule == "dot":
            return -(self.weights * share * ask).sum(axis=-1)
        return (self.weights * (share - ask) ** 2).sum(axis=-1)

    def plan(self, counts: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
        """(length, first number, last number + 1, first sequence, offset in the sequence).

        Pieces number first..last of a length go to sequences first sequence.. one by one.
        """
        residual = np.zeros((0, 3))  # of groups of alike bins
        copies, base, used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        out, bins = [], 0
        for length in sorted(counts, reverse=True):
            need, left, number = self.demand(length), counts[length], 0
            if (need > self.limits).any():
                raise ValueError(f"a piece of {length} tokens fits no sequence")
            while left:
                at = np.flatnonzero((residual >= need).all(axis=1))
                if len(at):
                    g = at[np.lexsort((base[at], self.score(residual[at], need)))[0]]
                else:  # as many new bins as this length fills
                    g, take = len(base), max(1, left // int(min(self.limits // need)))
                    residual, copies, base, used = np.vstack([residual, self.limits]), np.append(copies, take), np.append(base, bins), np.append(used, 0)
                    bins += take
                layers = min(left, int(min(residual[g] // need))) if self.rule == "norm" else 1
                take = min(left // layers, int(copies[g]))
                if take < copies[g]:  # the rest of the group stays as it is
                    residual = np.vstack([residual, residual[g]])
                    copies, base, used = np.append(copies, copies[g] - take), np.append(base, base[g] + take), np.append(used, used[g])
                    copies[g] = take
                for _ in range(layers):
                    out.append((length, number, number + take, int(base[g]), int(used[g])))
                    residual[g] -= need
                    used[g] += length
                    number, left = number + take, left - take
            alive = (residual[:, 0] > 0) & (residual[:, 1] > 0)
            residual, copies, base, used = residual[alive], copies[alive], base[alive], used[alive]
        return out


def best_fit_packing(docs: DataFrame, ranks_path: str, special: dict[str, int], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, packer: VectorBestFit | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids followed by id 0.  Null and empty texts are the single
    id 0.  Only documents over ``capacity`` are cut.  Repeated rows and rows without id
    are packed like others; an empty table gives an empty table; other columns are
    ignored.  Ties between alike bins go to the oldest; pieces of one length are
    interchangeable.

    Texts never move.  The driver sees one count per length (at most ``capacity`` rows)
    and makes the plan, whose rows grow with the number of distinct lengths only.
    Numbers within a length come from ranks within the input's partitions and running
    sums over partitions, one row for each, so a length that most pieces share is not
    gathered anywhere.
    """
    spark = docs.sparkSession
    marks = tuple(sorted(special.items()))
    rows = documents(docs, id_col, text_col).select("doc_id", "text", F.spark_partition_id().alias("part"))
    pieces = materialize(rows.mapInArrow(lambda it: _cut(it, ranks_path, marks, capacity), _PIECES), "pack-pieces")
    per_chunk = materialize(pieces.groupBy("length", "chunk").agg(F.count("*").alias("n")), "pack-chunks")
    counts = {int(r[0]): int(r[1]) for r in per_chunk.groupBy("length").agg(F.sum("n")).collect()}
    plan = (packer or VectorBestFit(capacity)).plan(counts)

    table = np.array(plan, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = spark.sparkContext.broadcast(table)  # bounded: see the class

    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialize(per_chunk.select("length", "chunk", F.coalesce(earlier, F.lit(0)).alias("before")), "pack-offsets")
    # offsets grow with the pieces, so they are never broadcast
    numbered = pieces.join(offsets.hint("merge"), ["length", "chunk"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("number"))

    def place(batches):
        rows = shared.value
        # one sorted key per plan row: length, then first number
        first = np.searchsorted(rows[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "number"))
            at = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                mine = length == n
                at[mine] = first[n] + np.searchsorted(rows[first[n] : first[n + 1], 1], number[mine], side="right") - 1
            sequence, offset = rows[at, 3] + number - rows[at, 1], rows[at, 4]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "piece", "start")], pa.array(length), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame) -> DataFrame:
    """Production parameters: byte_bpe_50k, 2048 tokens; the other limits follow from it."""
    import public_tokenizers

    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256})


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
