"""Substring dedup by level-wise doubling of repeated windows.

A window of ``w`` words that occurs twice holds repeated windows of every shorter
length.  The ladder therefore starts at a quarter of ``w``: only starts whose short
window repeats are extended to twice that length, and only starts that survive are
extended to ``w``.  It stops as soon as no candidate is left.

Level 1 does not send every short window.  Each ``w``-word window elects the short
window of smallest hash inside it; equal windows elect the same one, so a repeated
``w``-window always has a repeated elected window, and about 2 of ``w`` starts are
sent instead of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bucket_count, discard, flat, lengths, materialize, pack
from .words import Words, mix, signed, slices

WINDOW = 35
#: Occurrences within one slice from which a hash is settled locally.
LOCAL = 8
_ELECT = "bucket int, h array<bigint>, right array<bigint>, left array<bigint>, doc array<bigint>, tag array<int>, pos array<int>"
_SIDES = "bucket int, h array<bigint>, doc array<bigint>, tag array<int>, pos array<int>"
_FULL = "bucket int, h array<bigint>, h2 array<bigint>, doc array<bigint>, tag array<int>, pos array<int>"
_SPANS = "doc bigint, tag int, pos array<int>"


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the minimum of every run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best = np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        have += step
    return best[:n]


def _levels(window: int) -> tuple[int, int]:
    quarter = max(1, (window + 3) // 4)
    return quarter, min(window, 2 * quarter)


def _elected(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, elected position of each, elected positions without repeats)."""
    quarter, _ = _levels(window)
    n = len(words)
    ends = np.repeat(words.first[1:], words.counts)
    start = np.flatnonzero(np.arange(n) + window <= ends)
    if not len(start):
        return start, start, start
    sums = words.prefix()
    short = words.window_hash(sums, np.arange(n - quarter + 1), quarter)
    best = _sliding_argmin(short, window - quarter + 1)[start]
    return start, best, np.unique(best)


def _repeats(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first entry of every distinct key, occurrences of every entry's key)."""
    order = np.lexsort(keys)
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(order)))
    count = np.empty(len(order), dtype=np.int64)
    count[order] = np.repeat(size, size)
    return order[at], count


def _ask(key: np.ndarray, columns: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch | None:
    """Array rows that ask which hashes ``h`` (with ``h2`` where given) repeat; equal ones must have equal ``key``.

    A hash that occurs LOCAL times or more here is known to repeat.  Its places are dealt
    out by document with h = 0 (known), and two marks with pos = -1 tell its bucket, so
    the most frequent window in the corpus adds two entries per slice to its bucket.
    """
    columns = columns | {"h": np.where(columns["h"] == 0, np.uint64(1), columns["h"])}
    first, count = _repeats(*[columns[c] for c in ("h2", "h") if c in columns])
    known = count >= LOCAL
    bucket = (np.where(known, mix(columns["doc"].view(np.uint64)), key) % np.uint64(buckets)).astype(np.int32)
    mark = np.repeat(first[count[first] >= LOCAL], 2)
    marks = {c: columns[c][mark] if c in ("h", "h2") else np.zeros(len(mark), v.dtype) for c, v in columns.items()} | {"pos": np.full(len(mark), -1, np.int32)}
    columns = columns | {"h": np.where(known, np.uint64(0), columns["h"])}
    bucket = np.concatenate([bucket, (key[mark] % np.uint64(buckets)).astype(np.int32)])
    whole = {c: np.concatenate([columns[c], marks[c]]) for c in columns}
    return pack(bucket, {c: signed(v) if v.dtype == np.uint64 else v for c, v in whole.items()})


def _answered(table: pa.Table) -> np.ndarray:
    """Entries of asked places whose hash repeats."""
    h, pos = flat(table, "h"), flat(table, "pos")
    keys = [flat(table, "h2"), h] if "h2" in table.column_names else [h]
    return ((_repeats(*keys)[1] > 1) | (h == 0)) & (pos >= 0)


def _elect(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Level 1: hashes of elected short windows with the doubled windows to either side."""
    quarter, double = _levels(window)
    for batch in batches:
        ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        for a, b, words in slices(batch.column(2), False):
            _, _, pos = _elected(words, window)
            if not len(pos):
                continue
            sums = words.prefix()
            doc = np.searchsorted(words.first, pos, side="right") - 1
            lo, hi = words.first[doc], words.first[doc + 1]
            h = words.window_hash(sums, pos, quarter)
            right = np.where(pos + double <= hi, words.window_hash(sums, np.minimum(pos, len(words) - double), double), np.uint64(0))
            back = pos + quarter - double
            left = np.where(back >= lo, words.window_hash(sums, np.maximum(back, 0), double), np.uint64(0))
            out = _ask(h, {"h": h, "right": right, "left": left, "doc": ids[a:b][doc], "tag": tags[a:b][doc], "pos": (pos - lo).astype(np.int32)}, buckets)
            if out is not None:
                yield out


def _double(table: pa.Table, buckets: int) -> pa.Table:
    """Repeated short windows, extended to twice the length on both sides."""
    keep = _answered(table)
    place = {c: flat(table, c)[keep] for c in ("doc", "tag", "pos")}
    parts = []
    for name, salt in (("right", 1), ("left", 2)):
        h = flat(table, name)[keep]
        some = h != 0
        parts.append({"h": mix(h[some].view(np.uint64) + np.uint64(salt))} | {c: v[some] for c, v in place.items()})
    columns = {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}
    out = _ask(columns["h"], columns, buckets)
    if out is not None:
        return pa.Table.from_batches([out])
    longs, ints = pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int32()))
    return pa.table({"bucket": pa.array([], pa.int32()), "h": longs, "doc": longs, "tag": ints, "pos": ints})


def _survivors(table: pa.Table) -> pa.Table:
    """Repeated places, one row per document that has some here."""
    keep = _answered(table)
    doc, tag, pos = (flat(table, c)[keep] for c in ("doc", "tag", "pos"))
    order = np.lexsort((tag, doc))
    doc, tag, pos = doc[order], tag[order], pos[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    first = np.flatnonzero(new)
    offsets = pa.array(np.append(first, len(doc)).astype(np.int32))
    return pa.table({"doc": pa.array(doc[first], pa.int64()), "tag": pa.array(tag[first], pa.int32()), "pos": pa.ListArray.from_arrays(offsets, pa.array(pos, pa.int32()))})


def _full(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Last level: the windows that elected a surviving position; columns doc, tag, text, pos.

    Equal windows elect equal short windows, so all windows of one elected position
    travel to one bucket together.  What is removed is decided by two independent
    64-bit hashes of a window.
    """
    for batch in batches:
        ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        survive, count = flat(batch, "pos"), lengths(batch, "pos")
        firsts = np.append(0, np.cumsum(count))
        for a, b, words in slices(batch.column(2), False):
            start, best, _ = _elected(words, window)
            if not len(start):
                continue
            wanted = np.zeros(len(words) + 1, dtype=bool)
            place = survive[firsts[a] : firsts[b]] + np.repeat(words.first[:-1], count[a:b])
            wanted[np.minimum(place, len(words))] = True
            chosen = wanted[best]
            start, best = start[chosen], best[chosen]
            if not len(start):
                continue
            sums = words.prefix()
            key, h = words.window_hash(sums, best, _levels(window)[0]), words.window_hash(sums, start, window)
            h2 = words.window_hash(words.prefix(salt=1), start, window)
            doc = np.searchsorted(words.first, start, side="right") - 1
            yield _ask(key, {"h": h, "h2": h2, "doc": ids[a:b][doc], "tag": tags[a:b][doc], "pos": (start - words.first[doc]).astype(np.int32)}, buckets)


def _runs(pos: np.ndarray, window: int, n: int) -> np.ndarray:
    """Mask of the words that windows starting at ``pos`` cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + window, -1)
    return np.cumsum(edge[:n]) > 0


_RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"


def _apply(batches: Iterator[pa.RecordBatch], window: int, verbatim: bool) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, spans (start positions, null for none) and others that stay."""
    for batch in batches:
        spans = np.append(0, np.cumsum(lengths(batch.select(["spans"]), "spans")))
        starts = flat(batch, "spans").astype(np.int64)
        n_words, n_removed, kept = [], [], []
        for a, b, words in slices(batch.column(1), False):
            data = words.data.tobytes()
            begin, end = words.start.tolist(), words.end.tolist()
            for d in range(b - a):
                lo, hi = int(words.first[d]), int(words.first[d + 1])
                pos = starts[spans[a + d] : spans[a + d + 1]]
                if len(pos):
                    gone = _runs(pos[pos + window <= hi - lo], window, hi - lo)
                    stay = (np.flatnonzero(~gone) + lo).tolist()
                else:
                    stay = range(lo, hi)
                if verbatim and len(stay) == hi - lo:
                    n_words.append(hi - lo)
                    n_removed.append(0)
                    kept.append(data[words.offsets[d] : words.offsets[d + 1]])
                    continue
                n_words.append(hi - lo)
                n_removed.append(hi - lo - len(stay))
                kept.append(b" ".join([data[begin[i] : end[i]] for i in stay]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *batch.columns[3:]],
            names=["doc_id", "n_words", "n_removed", "kept_text", *batch.schema.names[3:]],
        )


def row_keys(text: Column, doc_id: Column) -> list[Column]:
    """``doc`` and ``tag``: rows share them only if id and text are equal.

    The id alone does not tell rows apart where ids repeat or are missing.
    """
    text = F.coalesce(text, F.lit(""))
    return [F.coalesce(doc_id, F.xxhash64(text)).alias("doc"), (F.crc32(text) - (1 << 31)).cast("int").alias("tag")]


def repeated_starts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Starts of repeated windows: doc, tag, pos; a document may have several rows.

    ``docs`` has doc, tag and text.
    """
    buckets = bucket_count(docs)
    elected = docs.mapInArrow(lambda it: _elect(it, window, buckets), _ELECT)
    doubled = materialize(elected.groupBy("bucket").applyInArrow(lambda t: _double(t, buckets), _SIDES), "windows-double")
    alive = doubled.groupBy("bucket").applyInArrow(_survivors, _SPANS)
    alive = materialize(alive.groupBy("doc", "tag").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pos")))).alias("pos")), "windows-alive")
    discard(doubled)
    suspects = docs.join(alive, ["doc", "tag"]).select("doc", "tag", "text", "pos")
    full = suspects.mapInArrow(lambda it: _full(it, window, buckets), _FULL)
    repeated = materialize(full.groupBy("bucket").applyInArrow(_survivors, _SPANS), "windows-repeated")
    discard(alive)
    return repeated


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, verbatim: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, and the columns of ``keep``.

    kept_text is the words that stay, joined by one space; with ``verbatim`` a text that
    loses nothing stays as it is.

    A word goes if any window of ``window`` consecutive words that covers it starts
    at another place too, in this document or another; all places go, the first one
    included.  Windows are judged on the input.  Null or empty text has no words and
    an empty kept_text; documents shorter than the window lose nothing.  Repeated rows are
    places like others, so they remove each other's windows; rows without id and rows
    that share an id with another text take part like others; an empty table gives an
    empty table; columns beyond ``keep`` are ignored and may have any names.

    Ids, positions and 64-bit hashes move; texts move twice, to meet the surviving
    starts and to meet the final ones.  A window that occurs in a third of all
    documents is settled inside slices, see ``_ask``.
    """
    text, doc_id = F.col(text_col), F.col(id_col).cast("long")
    keys = row_keys(text, doc_id)
    starts = repeated_starts(docs.select(*keys, text.alias("text")), window).groupBy("doc", "tag").agg(F.flatten(F.collect_list("pos")).alias("spans"))
    full = docs.select(*keys, doc_id.alias("doc_id"), text.alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    kept = "".join(f", `keep_{c}` {full.schema[f'keep_{c}'].dataType.simpleString()}" for c in keep)
    joined = full.join(starts, ["doc", "tag"], "left").select("doc_id", "text", "spans", *[f"keep_{c}" for c in keep])
    out = joined.mapInArrow(lambda it: _apply(it, window, verbatim), _RESULT + kept)
    return out.select("doc_id", "n_words", "n_removed", "kept_text", *[F.col(f"keep_{c}").alias(c) for c in keep])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
