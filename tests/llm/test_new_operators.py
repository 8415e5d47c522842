"""Concatenate and cut, hard negatives and fill-in-middle against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from studylens.llm import concat_cut as cc, fill_in_middle as fim, hard_negatives as hn, packing


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.no_truncation()
    out.no_padding()
    return out


def marks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256}


# concatenate and cut


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sStT09aé<|endoftext|> ́")), max_size=60))
def test_ids_equal_the_library(text):
    path, special = marks()
    coder, allowed = packing._encoder(path, tuple(special.items())), set(special)
    ids = coder.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids


LIBRARY = library()


def checked_pieces(pieces, rows, window):
    """Every id in one piece, sequences gapless, padding only where it must be."""
    wanted = {}
    for doc_id, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]
        wanted.setdefault(doc_id, []).append(np.array(ids, dtype="<u4"))
    seen = {}
    for p in pieces:
        seen.setdefault(p.doc_id, []).append(p)
    assert seen.keys() == wanted.keys()
    for doc_id, texts in wanted.items():
        assert sum(len(t) for t in texts) == sum(p.length for p in seen[doc_id])
        if len(texts) == 1:
            at = 0
            for p in sorted(seen[doc_id], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(texts[0])
                assert p.ids_crc32 == zlib.crc32(texts[0][at : at + p.length].tobytes())
                at += p.length
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window and at.bit_count() == 1  # 2048 or a smaller power of two: nothing is padded


@pytest.mark.parametrize("window", [2048, 64])
def test_concat_cut(spark, odd_docs, window):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    pieces = cc.concat_cut(odd_docs, *marks(), window=window).collect()
    checked_pieces(pieces, rows, window)
    assert len({p.sequence_id for p in pieces}) <= sum(p.length for p in pieces) // window + window.bit_length()


def test_concat_cut_odd_rows(spark, no_docs):
    assert cc.concat_cut(no_docs, *marks()).collect() == []
    rows = [(None, "a b"), (None, "a b"), (7, "same"), (7, "same"), (8, None), (-3, "<|endoftext|> x")]
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, part int, ids binary")
    checked_pieces(cc.concat_cut(df, *marks(), window=4).collect(), rows, 4)


def test_sequences_hold_the_ids(spark, odd_docs):
    pieces = cc.concat_cut(odd_docs, *marks(), window=256, with_ids=True)
    made = {r.sequence_id: r for r in cc.sequences(pieces).collect()}
    texts = {r.doc_id: LIBRARY.encode(r.text or "", add_special_tokens=False).ids + [1] for r in odd_docs.collect()}
    for r in made.values():
        for b in r.boundaries:
            assert list(r.ids[b.offset : b.offset + b.length]) == texts[b.doc_id][b.start : b.start + b.length]
    assert sum(len(r.ids) for r in made.values()) == sum(map(len, texts.values()))


def test_tail_cuts():
    for total in (0, 1, 2048, 2049, 4095, 5 * 2048 + 1300):
        ends = cc.tail_cuts(total, 2048)
        parts = np.diff(np.append(total - total % 2048, ends))
        assert all(int(x).bit_count() == 1 for x in parts) and parts.sum() == total % 2048


# hard negatives


def mined(rows, k=5):
    """Every pair, by the contract."""
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors = {(i, label, tuple(q)) for i, label, q in rows if i % 100 == 0}
    for i, label, q in anchors:
        scored = [(-score(q, r), j, other) for j, other, r in rows]
        positives = sorted((s, j) for s, j, other in scored if other == label and j != i)[:k]
        for s, j in positives:
            fits = sorted((t, n) for t, n, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s)[:k]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, rank int, anchor string"


def check_mining(spark, raw, parts=3):
    df = spark.createDataFrame([(*r, 1, "x") for r in raw], VECTORS).repartition(parts)
    got = sorted(map(tuple, hn.hard_negatives(hn.quantized(df), F.col("vec_id") % 100 == 0).collect()))
    clean = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in raw if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert got == mined(clean)
    return got


def vectors(rng, n, dims, labels):
    return [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


def test_hard_negatives(spark, monkeypatch):
    rng = random.Random(3)
    raw = vectors(rng, 700, 19, 4)
    copies = [(1000 + i, raw[0][1], i % 2) for i in range(150)]  # a frequent vector, ties everywhere
    assert len(check_mining(spark, raw + copies)) > 100
    monkeypatch.setattr(hn, "BLOCK_CELLS", 400)
    monkeypatch.setattr(hn, "GROUP_CELLS", 40)
    check_mining(spark, raw + copies)


def test_hard_negatives_odd_rows(spark):
    rng = random.Random(4)
    raw = vectors(rng, 220, 6, 3)
    odd = [(None, raw[0][1], 1), (300, None, 1), (301, [1.0, None], 1), (302, [math.nan] * 6, 1), (303, [math.inf] * 6, 2), (304, [], 1), (305, [0.5], 2), (306, [0.0] * 6, 0), (400, raw[1][1], None), (-100, raw[2][1], 2), (500, [], 0), (600, [0.0] * 6, 1)]
    again = [raw[5], raw[5], raw[100], raw[100], (200, raw[7][1], 2), (200, raw[8][1], 1)]
    check_mining(spark, raw + odd + again)
    check_mining(spark, [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-1.0, 0.0], 2)])  # a positive below zero
    check_mining(spark, [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 3.0], 2), (3, [0.1, 3.0], 2)])  # and one at zero
    check_mining(spark, [(0, [3e6, 1e6], 1), (1, [3e6, 1e6], 1), (2, [2.9e6, 1e6], 2)])
    assert hn.hard_negatives(hn.quantized(spark.createDataFrame([], VECTORS)), F.col("vec_id") % 100 == 0).collect() == []


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 40), st.sampled_from([0.0, 0.3, 0.9]))
def test_pruned_index_finds_all(seed, n, dims, zeros):
    rng = np.random.default_rng(seed)
    x = np.floor(256 * rng.normal(0, 0.3, (n, dims)) * (rng.random((n, dims)) >= zeros)).astype(np.int64)
    a = np.floor(256 * rng.normal(0, 0.3, dims)).astype(np.int64)
    exact = x @ a
    for t in {0, *np.sort(exact)[-3:].tolist(), int(exact.max()) + 1}:
        if t < 0:
            continue
        index = hn.PrunedIndex(x, hn._ratio(a, t))
        at, scores = index.search(a, np.arange(n), t)
        assert sorted(index.rows[at].tolist()) == np.flatnonzero(exact >= t).tolist()
        assert scores.tolist() == exact[index.rows[at]].tolist()


def test_pruned_index_leaves_strips_out():
    x = np.zeros((4, 24), dtype=np.int64)
    x[:, :8], x[:, 20] = 100, 1
    index = hn.PrunedIndex(x, 50.0)
    assert index.holders[0] == 4 and index.holders[-1] == 0


# fill-in-middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def transformed(doc_id, text):
    text = text or ""
    u, h = UNIT.findall(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    assert "".join(u) == text
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    if h4 % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, odd_docs, no_docs):
    made = fim.fill_in_middle(odd_docs)
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts) and {r.form for r in rows} == {"plain", "spm", "psm"}
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == transformed(r.doc_id, texts[r.doc_id])
        assert r.back == (texts[r.doc_id] or "")
    assert fim.fill_in_middle(no_docs).collect() == []


def test_fill_in_middle_odd_texts(spark, monkeypatch):
    base = ["", "<P", "<S> marked", "a <M>", "< P >", "\x0b\x0c", " lead and tail \n", "ÿ Ã¿", "\x00 nul", "<", "a<S b>", "日本 語", "P><S", " wide ", "x " * 50_000]
    rows = [(i, t) for i, t in enumerate(base * 8)] + [(None, "no id at all"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(*r, 5, "f") for r in rows], "doc_id long, text string, n int, form string")
    for size in (fim.SLICE_BYTES, 10):
        monkeypatch.setattr(fim, "SLICE_BYTES", size)
        got = sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fim.fill_in_middle(df).collect())))
        assert got == sorted(repr((i, *transformed(i, t))) for i, t in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\x0b\x0c\r<>PSMÿ")), max_size=30), min_size=1, max_size=6))
def test_units(texts):
    got = fim.units(pa.array([t.encode() for t in texts], pa.large_binary())).to_pylist()
    assert [[u.decode() for u in row] for row in got] == [UNIT.findall(t) for t in texts]


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_fill_in_middle"])
def test_sql(spark, name):
    from studylens.llm import queries
    from tests.conftest import SF
    from tests.harness import compare

    assert compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF) is None
