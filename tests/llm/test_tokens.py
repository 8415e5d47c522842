from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings, strategies as st

from studylens.llm import bpe, packing, token_counts

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

ODD = ["<|endoftext|>", "a<|endoftext|>b <|startoftext|> c  <|endoftext|>", "a   b", "a\n  b", "a\n \nb c", "x ", "x\n ", "  lead", "don't 'S ''s it's I'LL", "\x1c\x1d a\x1fb", "", "  \n\t ", "日本語テスト １２３ ½ ² ①", "a\u0085b​c  d", "\xa0 x", "🙂👍🏽 x🙂", "a" * 3000, "ab" * 40, "=" * 200, "x　 y", " " * 70 + "x", "\n" * 60, "ΟΔΟΣ ΣΑΣ", "İstanbul ẞ ŉ ǅ ﬁ", "é É"]


@pytest.fixture(scope="module")
def byte_level():
    return bpe.BytePairCodec(P.path("byte_bpe_50k.json")), tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", ODD)
def test_encode_like_the_library(byte_level, text):
    ours, library = byte_level
    ids = np.frombuffer(ours.encode_batch([text])[0], dtype="<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert ours.decode_bytes(np.array(ids, dtype="<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_encode_any_text(text):
    ours, library = bpe.codec(P.path("byte_bpe_50k.json")), tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert np.frombuffer(ours.encode_batch([text])[0], dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_decode_of_broken_bytes(byte_level):
    ours, library = byte_level
    for ids in ([255, 128, 17], [447], [447, 242, 247]):
        assert ours.decode_bytes(np.array(ids, dtype="<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)


def test_codec_query(spark, odd_docs, no_docs, byte_level):
    _, library = byte_level
    got = {r.doc_id: tuple(r)[1:] for r in bpe.round_trip_digests(odd_docs, P.path("byte_bpe_50k.json")).collect()}
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.round_trip_digests(no_docs, P.path("byte_bpe_50k.json")).collect() == []
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd_docs, P.path("byte_bpe_50k.json")), P.path("byte_bpe_50k.json")).collect()}
    assert back == {r.doc_id: r.text or "" for r in odd_docs.collect()}


def test_counts(spark, odd_docs, no_docs):
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "again"), (3, "again")], "doc_id long, text string")
    for docs in (odd_docs, df):
        want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False))) for r in docs.collect())
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, P.path("word_bpe_49k.json")).collect())
        assert got == want
    assert token_counts.token_counts(no_docs, P.path("word_bpe_49k.json")).collect() == []


def test_a_task_holds_small_blocks():
    """Eleven MB of text with 380,000 distinct words: no row over 4 MB, and the library's counts across blocks."""
    path, rng = P.path("word_bpe_49k.json"), np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnop"))
    words = ["".join(w) for w in letters[rng.integers(0, 16, (400_000, 8))].tolist()]
    docs = {i: " ".join([words[k] for k in rng.integers(0, 400_000, 400)]) for i in range(3000)}
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(docs)[i : i + 500], "text": list(docs.values())[i : i + 500]}) for i in range(0, 3000, 500)]
    rows = list(token_counts._blocks(iter(batches), path, 3))
    table = pa.Table.from_batches(rows)
    whole, asked = (table.filter(pc.less(table["bucket"], 0) if x else pc.greater_equal(table["bucket"], 0)) for x in (True, False))
    assert max(r.nbytes for r in rows) < 4 << 20 and len(whole) >= 3
    counts = pa.concat_tables([token_counts._count(asked.filter(pc.equal(asked["bucket"], k)), path) for k in range(3)])
    got = pa.concat_tables([token_counts._sum(whole.slice(i, 1), counts.filter(pc.equal(counts["block"], whole["block"][i]))) for i in range(len(whole))])
    library = tokenizers.Tokenizer.from_file(path).encode_batch_fast(list(docs.values()), add_special_tokens=False)
    assert dict(zip(got["doc_id"].to_pylist(), got["n_tokens"].to_pylist())) == dict(enumerate(map(len, library)))


@pytest.mark.parametrize("values", [[], [0], [5, -3, 2**31 - 1, -(2**31)], list(range(-500, 500))])
def test_packed_integers(values):
    values = np.array(values, dtype=np.int32)
    assert np.array_equal(token_counts._unpacked(token_counts._packed(values), len(values)), values)


def check_packing(rows, docs, library, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    total = 0
    for doc_id, text in docs.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), -(-total // capacity)


def test_packing_query(spark, odd_docs, no_docs, byte_level):
    _, library = byte_level
    rows = packing.pack_documents(odd_docs).collect()
    used, least = check_packing(rows, {r.doc_id: r.text for r in odd_docs.collect()}, library, 2048)
    assert used <= least + 1
    assert packing.pack_documents(no_docs).collect() == []
    assert len(packing.pack_documents(odd_docs.select("text", odd_docs.doc_id.cast("string").alias("doc_id")).filter("doc_id = '3'").unionByName(odd_docs.select("text", odd_docs.doc_id.cast("string").alias("doc_id")).filter("doc_id = '3'"))).collect()) == 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20), st.sampled_from(["dot", "norm"]), st.sampled_from([None, 3, 8]))
def test_plan_respects_every_capacity(counts, rule, max_docs):
    packer = packing.VectorBestFit(64, max_docs, 64.0 * 48, rule=rule)
    bins, numbers = {}, {}
    for length, first, last, sequence, offset in packer.plan(counts) if all(n * n <= 64 * 48 for n in counts) else []:
        for i in range(last - first):
            bins.setdefault(sequence + i, []).append((offset, length))
            numbers.setdefault(length, []).append(first + i)
    if bins:
        assert {k: sorted(v) for k, v in numbers.items()} == {k: list(range(n)) for k, n in counts.items()}
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 64 and len(content) <= (max_docs or 64) and sum(n * n for _, n in content) <= 64 * 48


def placed_one_by_one(packer, counts):
    """Contents of the bins when every piece is placed on its own."""
    bins = []
    for length in sorted(counts, reverse=True):
        need = packer.demand(length)
        for _ in range(counts[length]):
            fit = [i for i, (residual, _) in enumerate(bins) if (residual >= need).all()]
            if fit:
                i = min(fit, key=lambda i: (float(packer.score(bins[i][0], need)), i))
            else:
                i = len(bins)
                bins.append([packer.limits.copy(), []])
            bins[i][0] = bins[i][0] - need
            bins[i][1].append(length)
    return sorted(sorted(content) for _, content in bins)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 25), max_size=14), st.sampled_from([None, 3, 8]), st.sampled_from([None, 64.0 * 40]))
def test_plan_places_like_one_by_one(counts, max_docs, max_cost):
    packer = packing.VectorBestFit(64, max_docs, max_cost)
    bins = {}
    for length, first, last, sequence, _ in packer.plan(counts):
        for i in range(last - first):
            bins.setdefault(sequence + i, []).append(length)
    assert sorted(sorted(b) for b in bins.values()) == placed_one_by_one(packer, counts)


def test_limits_bind_without_costing_sequences(spark, byte_level):
    """Ten short texts and ten that nearly fill a sequence: at most two texts to a sequence still fit in ten."""
    path, library = byte_level
    texts = ["a b c"] * 10 + ["w" + " w" * 49] * 10
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, None)], "doc_id long, text string")
    packer = packing.VectorBestFit(64, max_docs=2, max_cost=64.0 * 64)
    rows = packing.best_fit_packing(docs, P.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256}, capacity=64, packer=packer).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r.length)
    assert len(by) == 11 and max(map(len, by.values())) == 2
