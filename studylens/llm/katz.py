"""Katz back-off bigram model, trained and applied as partitioned tables.

P(w | h) is the Good-Turing discounted relative frequency where (h, w) was seen, and
alpha(h) * P(w) otherwise; P(w) backs off to the mass that discounting the word counts
leaves for unknown words.  alpha(h) = (1 - sum of seen P(. | h)) / (1 - sum of their
P(w)), so every distribution sums to one exactly.

Words are numbered by hash bucket.  Each block of texts sends its distinct words, gets
numbers and counts back, and sends its word pairs to the bucket of their context,
together with the documents they stand in.  A bucket holds whole contexts, so counts,
discounts and alphas are local to it, and every occurrence is scored where its pair is
stored.  Contexts with a thousandth of all tokens are split over buckets by their
follower; their few sums are shared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bucket_count, crc_mods, discard, documents, flat, materialize
from .words import mix, signed, slices

#: Counts up to this are discounted.
DISCOUNTED = 5
#: Contexts with at least 1 / HOT of all training tokens are split; there are HOT at most.
HOT = 1024
#: Buckets of word pairs at least.  Every document touches many anyway.
PAIR_BUCKETS = 1024
BLOCK_SLICES = 12
#: Parts of the pair table that are merged one after the other, so that only one part's
#: shuffle is on disk at a time.
PARTS = 4
_END = np.uint64(0x5EED0E4D0FD0C5)
_FLOOR = 0.1


def squeeze(**columns: np.ndarray) -> bytes:
    """Integer or float columns as byte planes, compressed; see ``expand``."""
    parts = [np.array([len(columns)], dtype=np.int64).tobytes()]
    for values in columns.values():
        values = np.ascontiguousarray(values)
        parts.append(np.array([len(values), ord(values.dtype.kind), values.dtype.itemsize], dtype=np.int64).tobytes())
        parts.append(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def expand(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    count, at, out = int(raw[:8].view(np.int64)[0]), 8, []
    for _ in range(count):
        n, kind, size = (int(v) for v in np.frombuffer(raw[at : at + 24].tobytes(), dtype=np.int64))
        at += 24
        planes = raw[at : at + n * size].reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{chr(kind)}{size}"))
        at += n * size
    return out


def discounts(n: np.ndarray) -> np.ndarray:
    """Factor of each count 0..DISCOUNTED from the numbers n[1..] of types with each count.

    Good-Turing after Katz; where the counts of counts are too thin for it to lie in
    (0, 1], the count keeps half of its smallest step.
    """
    k, out = DISCOUNTED, np.ones(DISCOUNTED + 1)
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 0.0
    for r in range(1, k + 1):
        value = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else -1.0
        out[r] = value if 0 < value <= 1 else 1 - 0.5 / r
    return out


@dataclass(frozen=True)
class Words:
    """Unigram model: total, types and discount factors; probabilities from counts."""

    total: int
    types: int
    factors: tuple[float, ...]
    unknown: float
    scale: float

    def probability(self, count: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(count))
        seen = count * np.asarray(self.factors)[np.where(count <= DISCOUNTED, count, 0)] / self.total * self.scale
        return np.where(count > 0, seen, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + _FLOOR) / (self.total + _FLOOR * (self.types + 1)))


def unigram_model(total: int, n: np.ndarray, types: int) -> Words:
    """``n[r]``: word types with count r, for r up to DISCOUNTED + 1."""
    factors = discounts(n)
    r = np.arange(1, DISCOUNTED + 1)
    left = float((n[1 : DISCOUNTED + 1] * r * (1 - factors[1:])).sum() / total) if total else 1.0
    scale = 1.0
    if total and left < 1e-12:  # no word is rare: one occurrence goes to the unknown
        scale, left = total / (total + 1), 1 / (total + 1)
    return Words(total, types, tuple(factors), left, scale)


_BLOCKS = "block string, bucket int, blob binary, words array<bigint>, counts array<bigint>"


def _block_rows(ids: list, lens: list[np.ndarray], hashes: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    size, token = np.concatenate(lens), np.concatenate(hashes)
    held = crc_mods(ids, 10) == 0
    train = np.repeat(~held, size)
    word, local = np.unique(token, return_inverse=True)
    count = np.bincount(local[train], minlength=len(word))
    bucket = (word % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(word), dtype=np.int32)
    rank[order] = np.arange(len(word), dtype=np.int32)
    name = uuid.uuid4().hex
    known = np.array([i is not None for i in ids])
    number = np.array([i or 0 for i in ids], dtype=np.int64)
    blob = squeeze(ids=number, known=known.astype(np.int8), size=size.astype(np.int32), held=held.astype(np.int8), token=rank[local])
    none = pa.nulls(1, pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int32()), pa.array([blob], pa.binary()), none, none], names=["block", "bucket", "blob", "words", "counts"])
    keys, first = np.unique(bucket[order], return_index=True)
    offsets = pa.array(np.append(first, len(word)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (signed(word[order]), count[order].astype(np.int64))]
    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys.astype(np.int32)), pa.nulls(len(keys), pa.binary()), *lists], names=["block", "bucket", "blob", "words", "counts"])


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Token streams of blocks (words, then one end per text) and their distinct words."""
    for batch in batches:
        ids, lens, hashes, taken = [], [], [], 0
        all_ids = batch.column(0).to_pylist()
        for a, b, words in slices(batch.column(1), True):
            n = words.counts + 1
            token = np.empty(int(n.sum()), dtype=np.uint64)
            ends = np.zeros(len(token), dtype=bool)
            ends[np.cumsum(n) - 1] = True
            token[ends], token[~ends] = _END, words.hash
            ids += all_ids[a:b]
            lens.append(n)
            hashes.append(token)
            taken += 1
            if taken == BLOCK_SLICES:
                yield from _block_rows(ids, lens, hashes, buckets)
                ids, lens, hashes, taken = [], [], [], 0
        if ids:
            yield from _block_rows(ids, lens, hashes, buckets)


_NUMBERED = "block string, bucket int, blob binary, total bigint, types bigint, n array<bigint>"


def _number(table: pa.Table, buckets: int) -> pa.Table:
    """Corpus counts and numbers of one bucket's words, returned to every asking block.

    A word unknown to training has count 0 and number 0; others start at the bucket + 1.
    """
    word, count = flat(table, "words"), flat(table, "counts")
    _, inverse = np.unique(word, return_inverse=True)
    total = np.bincount(inverse, weights=count).astype(np.int64)
    seen = total > 0
    number = np.where(seen, (np.cumsum(seen) - 1) * buckets + table.column("bucket")[0].as_py() + 1, 0)
    sizes = np.append(0, np.cumsum([len(x) for x in table.column("words").to_pylist()]))
    blobs = [squeeze(number=number[inverse[a:b]], count=total[inverse[a:b]]) for a, b in zip(sizes[:-1], sizes[1:])]
    rest = [0] * (len(blobs) - 1)
    n = np.bincount(total[seen & (total <= DISCOUNTED + 1)], minlength=DISCOUNTED + 2)
    return pa.table(
        {
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "blob": pa.array(blobs, pa.binary()),
            "total": pa.array([int(total.sum()), *rest], pa.int64()),
            "types": pa.array([int(seen.sum()), *rest], pa.int64()),
            "n": pa.array([n.tolist(), *[None] * len(rest)], pa.list_(pa.int64())),
        }
    )


_PAIRS = "block string, bucket int, blob binary"


def _pairs(block: pa.Table, answers: pa.Table, model: Words, buckets: int) -> pa.Table:
    """Word pairs of a block by the bucket of their context, and its documents' figures.

    Pair columns: context, its count, follower, its count, document, occurrences
    (negative in held-out documents).
    """
    ids, known, size, held, token = expand(block.column("blob")[0].as_py())
    parts = [expand(x) for x in answers.sort_by("bucket").column("blob").to_pylist()]
    number, count = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    doc = np.repeat(np.arange(len(size)), size)
    c = count[token]
    base = np.bincount(doc, weights=model.base(c), minlength=len(size))
    n_known = np.bincount(doc, weights=c > 0, minlength=len(size)).astype(np.int64)
    name = block.column("block")[0].as_py()
    info = squeeze(ids=ids, known=known, held=held, size=size.astype(np.int64), n_known=n_known, base=base)

    # the end before a text is the context of its first word
    end_at = np.cumsum(size) - 1
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.append(0, end_at[:-1] + 1)] = token[end_at[0]]
    key = (doc * len(number) + before) * len(number) + token if len(number) ** 2 * len(size) < 1 << 62 else None
    if key is not None:
        key, times = np.unique(key, return_counts=True)
        follower, rest = key % len(number), key // len(number)
        context, doc = rest % len(number), rest // len(number)
    else:
        triple, times = np.unique(np.stack([doc, before, token], axis=1), axis=0, return_counts=True)
        doc, context, follower = triple.T
    times = np.where(held[doc] == 1, -times, times)
    h, w = number[context], number[follower]
    spread = count[context] * HOT >= model.total
    bucket = (mix(np.where(spread, mix(h.view(np.uint64)) + w.view(np.uint64), h.view(np.uint64))) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((doc, w, h, bucket))
    keys, first = np.unique(bucket[order], return_index=True)
    blobs = [info]
    for a, b in zip(first, np.append(first[1:], len(order))):
        at = order[a:b]
        blobs.append(squeeze(h=np.diff(h[at], prepend=0), ch=count[context[at]], w=w[at], cw=count[follower[at]], doc=doc[at].astype(np.int32), times=times[at].astype(np.int32)))
    return pa.table({"block": pa.array([name] * len(blobs)), "bucket": pa.array(np.append(-1, keys).astype(np.int32)), "blob": pa.array(blobs, pa.binary())})


_MODEL = "bucket int, blocks array<string>, blob binary, n array<bigint>, hot array<bigint>, hot_mass array<bigint>, hot_seen array<double>"


def _merge(table: pa.Table, model: Words) -> pa.Table:
    """The pairs of one bucket with their training counts, and where they occur.

    ``hot`` are contexts that other buckets share: per context its numbers of followers
    with count 1..DISCOUNTED and the sum of larger counts, and the P(w) of its followers.
    """
    blobs = table.column("blob").to_pylist()
    parts = [expand(b) for b in blobs]
    h = np.concatenate([np.cumsum(p[0]) for p in parts])
    ch, w, cw, doc, times = (np.concatenate([p[i] for p in parts]) for i in range(1, 6))
    source = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
    order = np.lexsort((doc, source, w, h))
    h, ch, w, cw, doc, times, source = (x[order] for x in (h, ch, w, cw, doc, times, source))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    at = np.flatnonzero(new)
    count = np.add.reduceat(np.maximum(times, 0), at).astype(np.int64)
    count[(h[at] == 0) | (w[at] == 0)] = 0
    blob = squeeze(h=np.diff(h[at], prepend=0), ch=ch[at], w=w[at], cw=cw[at], count=count, runs=np.diff(np.append(at, len(h))).astype(np.int32), doc=doc, source=source, times=np.abs(times))
    n = np.bincount(count[(count > 0) & (count <= DISCOUNTED + 1)], minlength=DISCOUNTED + 2)
    shared = (count > 0) & (ch[at] * HOT >= model.total)
    hot, group = np.unique(h[at][shared], return_inverse=True)
    c = count[shared]
    mass = np.zeros((len(hot), DISCOUNTED + 1), dtype=np.int64)
    np.add.at(mass, (group, np.where(c <= DISCOUNTED, c, 0)), np.where(c <= DISCOUNTED, 1, c))
    seen = np.bincount(group, weights=model.probability(cw[at][shared]), minlength=len(hot))
    return pa.table(
        {
            "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
            "blocks": pa.array([table.column("block").to_pylist()], pa.list_(pa.string())),
            "blob": pa.array([blob], pa.binary()),
            "n": pa.array([n.tolist()], pa.list_(pa.int64())),
            "hot": pa.array([hot.tolist()], pa.list_(pa.int64())),
            "hot_mass": pa.array([mass.ravel().tolist()], pa.list_(pa.int64())),
            "hot_seen": pa.array([seen.tolist()], pa.list_(pa.float64())),
        }
    )


def _evaluate(batches: Iterator[pa.RecordBatch], model: Words, factors: np.ndarray, hot: dict[int, tuple[float, float]]) -> Iterator[pa.RecordBatch]:
    """Sums of log10 P(w | h) by block and document, from one bucket's pairs at a time."""
    for batch in batches:
        for blocks, blob in zip(batch.column("blocks").to_pylist(), batch.column("blob").to_pylist()):
            h, ch, _, cw, count, runs, doc, source, times = expand(blob)
            h = np.cumsum(h)
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            kept = count * factors[np.where(count <= DISCOUNTED, count, 0)]
            p_word = model.probability(cw)
            mass = np.add.reduceat(kept, start)
            seen = np.add.reduceat(np.where(count > 0, p_word, 0.0), start)
            total = ch[start].astype(float)
            for i in np.flatnonzero(ch[start] * HOT >= model.total):
                mass[i], seen[i] = hot.get(int(h[start[i]]), (0.0, 0.0))
            some = total > 0
            left = 1 - mass / np.where(some, total, 1)
            bare = some & (left < 1e-12)  # nothing was discounted: keep one occurrence back
            scale = np.where(bare, total / (total + 1), 1.0)
            left = np.where(bare, 1 / (total + 1), left)
            alpha = np.where(some & (mass > 0), left / np.maximum(1 - seen, 1e-300), 1.0)
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
            p = np.where(count > 0, kept / np.where(some, total, 1)[group] * scale[group], alpha[group] * p_word)
            value = np.repeat(np.log10(p), runs) * times
            where = source.astype(np.int64) << 32 | doc
            order = np.argsort(where, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(where[order]) != 0))
            sums, at = np.add.reduceat(value[order], first), where[order][first]
            edges = np.append(np.flatnonzero(np.append(True, np.diff(at >> 32) != 0)), len(at))
            out = [(blocks[int(at[a] >> 32)], squeeze(doc=(at[a:b] & 0xFFFFFFFF).astype(np.int32), value=sums[a:b])) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.binary())], names=["block", "blob"])


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _collect(info: pa.Table, sums: pa.Table) -> pa.Table:
    ids, known, held, size, n_known, base = expand(info.column("blob")[0].as_py())
    score = np.zeros(len(ids))
    for blob in sums.column("blob").to_pylist():
        doc, value = expand(blob)
        score[doc] += value
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=known == 0), "held_out": pa.array(held == 1), "n_tokens": pa.array(size), "n_known": pa.array(n_known), "base_score": pa.array(base), "score": pa.array(score)})


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on documents whose crc32(doc_id as text) mod 10 is not 0 and scores all.
    Null and empty texts are their end alone (one token); repeated rows count and score
    each; rows without id hash as empty text; without training tokens every probability
    is 1 in ``score``; an empty table gives an empty table; other columns are ignored.

    The driver sees the counts of counts, the totals, and the sums of at most HOT
    contexts; the model stays in tables partitioned by context.
    """
    spark = docs.sparkSession
    words, pairs = bucket_count(docs), max(PAIR_BUCKETS, bucket_count(docs))
    blocks = documents(docs, id_col, text_col).mapInArrow(lambda it: _blocks(it, words), _BLOCKS)
    blocks = materialize(blocks.withColumn("part", (F.col("bucket") >= 0).cast("int")), "lm-blocks", "part")
    asked = blocks.filter("part = 1").select("block", "bucket", "words", "counts")
    numbered = materialize(asked.groupBy("bucket").applyInArrow(lambda t: _number(t, words), _NUMBERED), "lm-words")
    discard(blocks, part="part=1")
    totals = numbered.agg(F.sum("total"), F.sum("types"), *[F.sum(F.col("n")[r]) for r in range(DISCOUNTED + 2)]).first()
    total, types, *n = (int(x or 0) for x in totals)
    model = unigram_model(total, np.array(n), types)

    whole = blocks.filter("part = 0").select("block", "blob")
    answers = numbered.select("block", "bucket", "blob")
    stored = materialize(whole.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda b, a: _pairs(b, a, model, pairs), _PAIRS).withColumn("part", F.pmod("bucket", F.lit(PARTS))), "lm-pairs", "part")
    discard(blocks, numbered)
    info = materialize(stored.filter("bucket < 0").select("block", "blob"), "lm-documents")
    parts = []
    for p in range(PARTS):
        part = stored.filter(f"part = {p} and bucket >= 0").select("block", "bucket", "blob")
        parts.append(materialize(part.groupBy("bucket").applyInArrow(lambda t: _merge(t, model), _MODEL), f"lm-model-{p}"))
        discard(stored, part=f"part={p}")
    table = reduce(DataFrame.unionByName, parts)
    discard(stored)

    n = table.agg(*[F.sum(F.col("n")[r]) for r in range(DISCOUNTED + 2)]).first()
    factors = discounts(np.array([int(x or 0) for x in n]))
    width = DISCOUNTED + 1
    each = table.select(F.explode(F.arrays_zip("hot", "hot_seen", F.transform("hot", lambda x, i: F.slice("hot_mass", i * width + 1, width)).alias("mass"))).alias("x"))
    sums = each.groupBy("x.hot").agg(F.sum("x.hot_seen"), *[F.sum(F.col("x.mass")[r]) for r in range(width)]).collect()
    hot = {int(r[0]): (float(r[2] + sum(r[2 + k] * k * factors[k] for k in range(1, width))), float(r[1])) for r in sums}

    scored = materialize(table.select("blocks", "blob").mapInArrow(lambda it: _evaluate(it, model, factors, hot), "block string, blob binary"), "lm-sums")
    discard(*parts)
    out = info.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(_collect, _SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
