"""Near-duplicate documents by SuperMinHash, banding, verification and union-find groups.

SuperMinHash gives each element one permutation of the registers: in round j the
element offers the value j + r to the j-th register of its permutation.  Registers keep
minima.  The offers of round j are at least j, so a document is done once all its
registers are below the next round; for n elements and m registers that takes about
m ln m / n rounds.  The lockstep below runs round j for all documents of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, documents, flat, lengths, materialize
from .components import connected_components
from .words import Words, mix, signed, slices

REGISTERS = 128
#: Rows per band.  A pair of similarity 0.8 misses all 32 bands with probability 5e-8.
BAND_ROWS = 4
#: Parts that a set is split into by hash, one checksum byte each.  Two sets differ in at
#: least as many elements as parts differ, so the parts bound the similarity from above.
PARTS = 256
#: Orders from which the compared member of a bucket is drawn, by band.
ORDERS = 4
#: Members of a bucket that meet in one task at a time.
CHUNK = 256
_STEP = 0x9E3779B97F4A7C15


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, and each document's first index.

    Documents with fewer words than ``size`` have their whole sequence as one shingle;
    documents without words have none.
    """
    sums, counts = words.prefix(), words.counts
    spans = np.maximum(counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), spans)
    start = np.arange(len(doc)) - np.repeat(np.append(0, np.cumsum(spans))[:-1], spans) + words.first[doc]
    h = words.window_hash(sums, start, np.minimum(size, counts[doc]))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(counts) + 1))


def super_minhash(h: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers (documents x registers, uint64) of the sets h[first[d]:first[d + 1]]."""
    n_docs = len(first) - 1
    out = np.full(n_docs * registers, np.iinfo(np.uint64).max, dtype=np.uint64)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    perm = None
    for j in range(registers):
        if not len(h):
            break
        rnd = mix(h + np.uint64((j + 1) * _STEP % (1 << 64)))
        k = j + ((rnd & np.uint64(0xFFFFFFFF)) * np.uint64(registers - j) >> np.uint64(32)).astype(np.int64)
        if perm is None:  # the permutation is still the identity
            slot = k
        else:
            rows = np.arange(len(h))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(out, doc * registers + slot, np.uint64(j << 32) + (rnd >> np.uint64(32)))
        live = out.reshape(n_docs, registers).max(axis=1) >= np.uint64((j + 1) << 32)
        stay = live[doc]
        if perm is None:
            perm = np.tile(np.arange(registers, dtype=np.uint8 if registers <= 256 else np.uint16), (int(stay.sum()), 1))
            perm[np.arange(len(perm)), k[stay]] = 0
        else:
            perm = perm[stay]
        h, doc = h[stay], doc[stay]
    return out.reshape(n_docs, registers)


_SIGNED = "doc_id bigint, n bigint, set1 bigint, set2 bigint, bands array<bigint>, parts binary"


def _signatures(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    odd = np.uint64(2) * np.arange(BAND_ROWS, dtype=np.uint64) + np.uint64(3)
    for batch in batches:
        ids = batch.column(0)
        for a, b, words in slices(batch.column(1), True):
            h, first = shingle_sets(words, size)
            n = np.diff(first)
            sums = [np.append(np.uint64(0), np.cumsum(mix(h + np.uint64(s)))) for s in (1, 2)]
            regs = mix(super_minhash(h, first))
            bands = mix((regs.reshape(len(n), -1, BAND_ROWS) * mix(odd)).sum(axis=2, dtype=np.uint64) + np.arange(REGISTERS // BAND_ROWS, dtype=np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands.shape[1]), pa.array(signed(bands).ravel()))
            code = mix(h + np.uint64(3))
            part = np.repeat(np.arange(len(n)) * PARTS, n) + (code % np.uint64(PARTS)).astype(np.int64)
            parts = np.bincount(part, weights=(code >> np.uint64(56)).astype(float), minlength=len(n) * PARTS).astype(np.int64).astype(np.uint8)
            parts = pa.Array.from_buffers(pa.binary(PARTS), len(n), [None, pa.py_buffer(parts.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a).cast(pa.int64()), pa.array(n.astype(np.int64)), *[pa.array(signed(s[first[1:]] - s[first[:-1]])) for s in sums], lists, parts],
                names=["doc_id", "n", "set1", "set2", "bands", "parts"],
            )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Full shingle sets of candidate documents as sorted hash lists."""
    for batch in batches:
        for a, b, words in slices(batch.column(1), True):
            h, first = shingle_sets(words, size)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(h)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), lists], names=["doc_id", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Columns a, b, left, right (hash lists): pairs with 100 * common >= percent * union."""
    for batch in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
        left, right = flat(batch, "left"), flat(batch, "right")
        n, m = lengths(batch, "left"), lengths(batch, "right")
        i, j = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(m))
        keep = []
        for p in range(len(n)):
            both = np.concatenate([left[i[p] : i[p + 1]], right[j[p] : j[p + 1]]])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (int(n[p]) + int(m[p]) - common))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Every member of a bucket with one member drawn by hash for that bucket.

    Bands share a few orders, so buckets of one large group mostly draw the same member.
    """
    draw = F.struct(F.xxhash64("id", F.pmod("band", F.lit(ORDERS))).alias("r"), "id", "n")
    hubs = materialize(members.groupBy("band").agg(F.min(draw).alias("hub"), F.count("*").alias("k")).filter("k > 1").select("band", "hub"), "band-hubs")
    pairs = members.join(hubs, "band").filter(f"id <> hub.id and 100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")
    return pairs.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def _bounded(left: dict[str, np.ndarray], right: dict[str, np.ndarray], same: bool, band: int, percent: int) -> np.ndarray:
    """Index pairs of different components that may be similar enough, at their first common band."""
    i, j = np.nonzero(left["comp"][:, None] != right["comp"][None, :])
    if same:
        i, j = i[i < j], j[i < j]
    n, m = left["n"][i], right["n"][j]
    # common elements needed for the percentage, then the most that may differ
    room = n + m - 2 * -(-percent * (n + m) // (100 + percent))
    ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    i, j, room = i[ok], j[ok], room[ok]
    found = []
    for k in range(0, len(i), 8192):
        x, y = i[k : k + 8192], j[k : k + 8192]
        near = (left["parts"][x] != right["parts"][y]).sum(axis=1) <= room[k : k + 8192]
        x, y = x[near], y[near]
        common = left["bands"][x] == right["bands"][y]
        first = np.take_along_axis(left["bands"][x], common.argmax(axis=1)[:, None], axis=1)[:, 0] if len(x) else x
        here = first == band
        found.append(np.stack([x[here], y[here]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)


def _members_of(column: pa.Array, row: int) -> dict[str, np.ndarray]:
    items = column.slice(row, 1).flatten()
    get = lambda name: items.field(name)
    size = len(items)
    return {
        "id": get("id").to_numpy(zero_copy_only=False),
        "n": get("n").to_numpy(zero_copy_only=False),
        "comp": get("comp").to_numpy(zero_copy_only=False),
        "bands": get("bands").flatten().to_numpy(zero_copy_only=False).reshape(size, -1),
        "parts": np.frombuffer(b"".join(get("parts").to_pylist()), dtype=np.uint8).reshape(size, PARTS),
    }


def _chunk_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Columns band, chunk, other, left, right (lists of members)."""
    for batch in batches:
        for row in range(batch.num_rows):
            left, right = _members_of(batch.column("left"), row), _members_of(batch.column("right"), row)
            same = batch.column("chunk")[row].as_py() == batch.column("other")[row].as_py()
            at = _bounded(left, right, same, batch.column("band")[row].as_py(), percent)
            a, b = left["id"][at[:, 0]], right["id"][at[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _open_pairs(members: DataFrame, signs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs left to check: members of one bucket that still lie in different components.

    A bucket of k members is cut into chunks of about CHUNK; chunks meet pairwise in a
    task, where sizes and parts rule out what cannot be similar enough.  Rows between
    tasks are chunks and the few pairs that remain, never all pairs of a bucket.
    """
    named = materialize(members.select("band", "id").join(groups, "id", "left").select("band", "id", F.coalesce("component", "id").alias("comp")), "near-named")
    open_ = materialize(named.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo <> hi").select("band", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")), "near-open")
    placed = named.join(open_, "band").select("band", "id", "comp", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"))
    placed = placed.join(signs.select(F.col("doc_id").alias("id"), "n", "bands", "parts"), "id")
    chunks = materialize(placed.groupBy("band", "chunk").agg(F.collect_list(F.struct("id", "n", "comp", "bands", "parts")).alias("left")), "near-chunks")
    others = chunks.select("band", F.col("chunk").alias("other"), F.col("left").alias("right"))
    meeting = chunks.join(others, "band").filter("chunk <= other")
    return meeting.mapInArrow(lambda it: _chunk_pairs(it, percent), "a bigint, b bigint")


def _links(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(confirmed pairs, all pairs): confirmed on the full sets, cut anew from candidates' texts.

    Candidate ids grow with the corpus, so they meet the texts in a shuffle at every size.
    """
    pairs = materialize(pairs, "near-pairs", batch_rows=16)  # a row may be two chunks of members
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = materialize(rows.join(ids.hint("merge"), "doc_id").select("doc_id", "text").mapInArrow(lambda it: _sets(it, size), "doc_id bigint, shingles array<bigint>"), "near-sets", batch_rows=500)
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    found = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "left", "right").mapInArrow(lambda it: _verify(it, percent), "a bigint, b bigint")
    found = materialize(found, "near-links", batch_rows=500)
    discard(sets)
    return found, pairs


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z.  Two documents
    are linked if 100 * |common| >= percent * |union| of their distinct shingles; the
    smallest doc_id of a connected group is its component and stays.  Null or empty
    text has no shingles and is linked with nothing; texts shorter than a shingle are
    one shingle.  Identical sets are one class from the start and are never paired.
    Repeated rows are one class and all kept if their id is; rows without id join the
    class of an equal set and are else alone with a null component; an empty table gives
    an empty table, and other columns are ignored.

    Links are found bucket by bucket and confirmed on the full sets.  First every member
    of a bucket is compared with one drawn member; in a group of copies that joins
    nearly all of them without listing pairs.  Buckets whose members then still lie in
    different components are compared in full, in chunks, so no pair that shares a band
    is left unchecked unless it is in one component already.
    """
    rows = documents(docs, id_col, text_col)
    signs = materialize(rows.mapInArrow(lambda it: _signatures(it, shingle), _SIGNED), "near-signs")
    classes = materialize(signs.filter("n > 0").groupBy("set1", "set2").agg(F.min("doc_id").alias("rep")), "near-classes")
    reps = signs.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    members = reps.select(F.col("doc_id").alias("id"), "n", F.explode("bands").alias("band"))
    shared = materialize(members.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1").select("band"), "near-bands")
    members = materialize(members.join(shared, "band", "left_semi"), "near-members")
    discard(shared)

    links, tried = _links(_star_pairs(members, percent), rows, shingle, percent)
    groups = materialize(connected_components(links), "near-groups")
    more, _ = _links(_open_pairs(members, signs, groups, percent).join(tried, ["a", "b"], "left_anti"), rows, shingle, percent)
    groups = materialize(connected_components(links.unionByName(more)), "near-groups")

    joined = signs.select("doc_id", "n", "set1", "set2").join(classes, ["set1", "set2"], "left")
    component = joined.join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    chosen = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep", "doc_id"))
    return component.select("doc_id", F.col("n").alias("n_shingles"), chosen.alias("component_id"), F.coalesce(F.col("doc_id") == chosen, chosen.isNull()).alias("kept"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, percent=80)
