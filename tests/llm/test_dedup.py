from __future__ import annotations

import hashlib
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from studylens.llm import minhash, substring_dedup as sub
from studylens.llm.components import connected_components
from studylens.llm.exact_dedup import exact_dedup
from studylens.llm.words import Words

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_exact(spark, odd_docs, no_docs):
    rows = pairs(odd_docs)
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = {r.doc_id: tuple(r)[1:] for r in exact_dedup(odd_docs).collect()}
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert got == want
    assert exact_dedup(no_docs).collect() == []


def test_exact_repeated_rows_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (None, "y")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup(df).collect())
    assert got == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]


def brute_windows(rows, size):
    count, words = Counter(), {i: WORD.findall(t or "") for i, t in rows}
    for w in words.values():
        count.update(tuple(w[p : p + size]) for p in range(len(w) - size + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if count[tuple(w[p : p + size])] > 1:
                gone[p : p + size] = [True] * size
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("size", [35, 8, 2])
def test_substrings(spark, odd_docs, no_docs, size):
    rows = [r for r in pairs(odd_docs)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in sub.substring_dedup(odd_docs, window=size).collect()}
    assert got == brute_windows(rows, size)
    assert sub.substring_dedup(no_docs, window=size).collect() == []


def test_substrings_of_one_frequent_window(spark):
    line = " ".join(f"q{i}" for i in range(40))
    df = spark.createDataFrame([(i, f"{line} {line} own{i}") for i in range(30)] + [(None, line), (99, line[:-1])], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in sub.substring_dedup(df).collect()}
    assert all(got[i] == (81, 80) for i in range(30))
    assert got[None] == (40, 40) and got[99] == (40, 39)


def test_substrings_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "a  b", "x"), (2, None, None)], "doc_id long, text string, text_2 string")
    got = sorted(tuple(r) for r in sub.substring_dedup(df, verbatim=True, keep=("text_2",)).select("doc_id", "kept_text", "text_2").collect())
    assert got == [(1, "a  b", "x"), (2, "", None)]


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[p : p + size]) for p in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_groups(rows, size, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("size", [4, 5])
def test_near(spark, odd_docs, no_docs, size):
    got = {r.doc_id: tuple(r)[1:] for r in minhash.minhash_dedup(odd_docs, shingle=size).collect()}
    assert got == brute_groups(pairs(odd_docs), size)
    assert minhash.minhash_dedup(no_docs).collect() == []


def test_near_group_of_loose_copies(spark):
    """A group whose members are closer to the original than to each other, in a hub bucket."""
    import random

    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for p in rng.sample(range(200), rng.choice([1, 3, 6])):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in minhash.minhash_dedup(df, shingle=4).collect()}
    assert got == brute_groups(rows, 4)


def test_near_without_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "other words are here now too")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.minhash_dedup(df, shingle=4).collect())
    assert got == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True)]


def slow_superminhash(h, m):
    """One element at a time, with the same random numbers."""
    from studylens.llm.words import mix

    out = [2**64 - 1] * m
    for x in h:
        perm = list(range(m))
        for j in range(m):
            rnd = int(mix(np.array([(int(x) + (j + 1) * minhash._STEP) % 2**64], dtype=np.uint64))[0])
            k = j + ((rnd & 0xFFFFFFFF) * (m - j) >> 32)
            perm[j], perm[k] = perm[k], perm[j]
            out[perm[j]] = min(out[perm[j]], (j << 32) + (rnd >> 32))
    return out


def test_superminhash_stops_early_without_loss():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 1, 3, 40, 300)]
    first = np.append(0, np.cumsum([len(s) for s in sets]))
    got = minhash.super_minhash(np.concatenate(sets), first, 16)
    for row, s in zip(got, sets):
        assert row.tolist() == slow_superminhash(s, 16)


def test_superminhash_estimates():
    rng = np.random.default_rng(2)
    both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    left, right = np.concatenate([both, a]), np.concatenate([both, b])
    regs = minhash.super_minhash(np.concatenate([left, right]), np.array([0, 900, 1800]))
    assert abs((regs[0] == regs[1]).mean() - 0.8) < 0.12


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_match_the_pattern(texts):
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    w = Words(data, np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64), False)
    got = [data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    assert got == [x for r in raw for x in WORD.findall(r.decode())]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (100, 102), (200, 200)] + [(500, i) for i in range(501, 540)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = {r.id: r.component for r in connected_components(df).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)} | {i: 500 for i in range(500, 540)}
    assert got == want
    assert connected_components(df.limit(0)).collect() == []


def test_substrings_of_rows_without_or_with_shared_ids(spark):
    passage = lambda k: " ".join(f"{k}{i}" for i in range(40))
    a, b, c = passage("a"), passage("b"), passage("c")
    rows = [(None, a), (2, a), (1, b + " own"), (1, c), (3, b), (None, "x y"), (None, None), (4, c + " d"), (4, c + " d")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, doc int, tag int")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in sub.substring_dedup(df).collect())
    assert got == sorted([(0, 40, 40, ""), (2, 40, 40, ""), (1, 41, 40, "own"), (1, 40, 40, ""), (3, 40, 40, ""), (0, 2, 0, "x y"), (0, 0, 0, ""), (4, 41, 41, ""), (4, 41, 41, "")])
