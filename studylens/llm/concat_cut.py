"""Concatenate and cut: all token ids in one long row of places, cut into fixed windows.

First pass: every partition of the input writes its documents' ids with their place
within the partition, and Spark sums each partition's tokens.  The prefix sums of those
totals are where partitions begin in the whole.  Second pass: a document's ids are cut
where a window ends; each cut piece is a boundary record that says which window it lies
in and where.  Nothing is sorted and no ids are shuffled.

What is left over behind the last full window is cut at falling powers of two, whose
sequences need no padding: 1,300 tokens are sequences of 1,024, 256, 16 and 4.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, documents, materialize, texts
from .packing import _encoder

WINDOW = 2048
END = 1
_CODED = "part int, doc_id bigint, place bigint, doc_tokens bigint, ids binary"


def _coded(batches: Iterator[pa.RecordBatch], ranks_path: str, special: tuple) -> Iterator[pa.RecordBatch]:
    """Ids of every document with the end mark, and their place among this partition's ids."""
    coder, allowed, place = _encoder(ranks_path, special), {s for s, _ in special}, 0
    for batch in batches:
        places, sizes, ids_of = [], [], []
        for data in texts(batch.column("text")):
            text = data.decode()
            ids = coder.encode_to_numpy(text, allowed_special=allowed if any(s in text for s in allowed) else set(), disallowed_special=())
            ids = np.append(ids, END).astype("<u4")
            places.append(place)
            sizes.append(len(ids))
            ids_of.append(ids.tobytes())
            place += len(ids)
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids_of, pa.binary())], names=["part", "doc_id", "place", "doc_tokens", "ids"])


def tail_cuts(total: int, window: int) -> np.ndarray:
    """Ends of the sequences behind the last full window: falling powers of two."""
    at = total - total % window
    ends = []
    for bit in reversed(range((total - at).bit_length())):
        if (total - at) >> bit & 1:
            ends.append(at + (1 << bit))
            at += 1 << bit
    return np.array(ends, dtype=np.int64)


_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _cut(batches: Iterator[pa.RecordBatch], base: dict[int, int], total: int, window: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Boundary records of all documents of a batch."""
    full, tails = total // window, tail_cuts(total, window)
    for batch in batches:
        part, place, size = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "place", "doc_tokens"))
        first = np.array([base[p] for p in part.tolist()], dtype=np.int64) + place
        last = first + size - 1

        def sequence(at: np.ndarray) -> np.ndarray:
            return np.where(at < full * window, at // window, full + np.searchsorted(tails, at, side="right"))

        begins = np.append(np.arange(0, 0), tails[:-1]) if len(tails) else np.zeros(0, dtype=np.int64)
        begins = np.concatenate([[full * window], begins]).astype(np.int64)

        def begin(seq: np.ndarray) -> np.ndarray:
            return np.where(seq < full, seq * window, begins[np.clip(seq - full, 0, len(begins) - 1)])

        s0 = sequence(first)
        counts = sequence(last) - s0 + 1
        row = np.repeat(np.arange(len(first)), counts)
        seq = s0[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = np.maximum(begin(seq), first[row])
        stop = np.minimum(np.where(seq + 1 < full + len(tails), begin(seq + 1), total), last[row] + 1)
        offset, inner, length = start - begin(seq), start - first[row], stop - start
        ids = batch.column("ids")
        views, crc, held = [memoryview(x.as_buffer()) for x in ids], [], []
        for r, a, n in zip(row.tolist(), inner.tolist(), length.tolist()):
            piece = views[r][4 * a : 4 * (a + n)]
            crc.append(zlib.crc32(piece))
            if with_ids:
                held.append(np.frombuffer(piece, dtype=np.int32))
        columns = [batch.column("doc_id").take(pa.array(row)), pa.array(inner), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[row]), pa.array(seq), pa.array(offset)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns, names = [*columns, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def concat_cut(docs: DataFrame, ranks_path: str, special: dict[str, int], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One boundary record per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its token ids followed by id 1; null and empty texts are the single id
    1.  Documents follow each other as the input's partitions hold them, repeated rows
    and rows without id like others.  A piece ends where its document or its window does.
    An empty table gives an empty table; other columns are ignored.

    The driver holds one total for each input partition, 16 bytes for 128 MB of text or
    so, and sends their prefix sums to all tasks.  Ids are stored once and never
    shuffled; Arrow batches hold 500 documents, and no more bytes than the session's
    limit for a batch.
    """
    marks = tuple(sorted(special.items()))
    rows = documents(docs, id_col, text_col).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    coded = materialize(rows.mapInArrow(lambda it: _coded(it, ranks_path, marks), _CODED), "concat-ids", batch_rows=500)
    totals = sorted((int(p), int(n)) for p, n in coded.groupBy("part").agg(F.sum("doc_tokens")).collect())
    ends = np.cumsum([n for _, n in totals]).tolist()
    base = docs.sparkSession.sparkContext.broadcast({p: end - n for (p, n), end in zip(totals, ends)})  # bounded: one number per partition
    total = ends[-1] if ends else 0
    schema = _PIECE + (", ids array<int>" if with_ids else "")
    pieces = materialize(coded.mapInArrow(lambda it: _cut(it, base.value, total, window, with_ids), schema), "concat-pieces", batch_rows=500)
    discard(coded)
    return pieces


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids, boundaries (offset, doc_id, start, length) from pieces with ids.

    A sequence has at most as many pieces as tokens, so a group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.transform("parts", lambda p: F.struct(p.offset.alias("offset"), p.doc_id.alias("doc_id"), p.start.alias("start"), p.length.alias("length"))).alias("boundaries"))


def op11_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return concat_cut(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256})
