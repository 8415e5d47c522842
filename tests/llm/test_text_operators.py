from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from studylens.llm import katz, license_scan, media, toxicity

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_license_scan(spark, no_docs):
    texts = [None, "", "CC-BY-SA 4.0 and cc by", "GNU General Public License version 3 or any later version", "all rights reserved all rights reserved", "under the MIT License; Apache License, Version 2.0", "ccc by", "general  public\nlicense éall rights reserved", "x" * 5000 + " All Rights Reserved."]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, "mit license", "k")], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        w = word.findall((t or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            hits = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert got[2].labels == "cc-by,cc-by-sa-4.0" and got[5].labels == "apache-2,mit" and got[None].labels == "mit"
    assert "gpl-3+" in got[3].labels and "gpl-3," not in got[3].labels + ","
    assert license_scan.license_scan(no_docs).collect() == []


def slow_labels(text: str, rules) -> tuple[set[str], float]:
    """Every rule without its gate, containment by comparing all pairs of detections."""
    joined = b" " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))).encode() + b" "
    found = []
    for rule in rules:
        found += [(m.start(), m.end(), rule) for m in re.finditer(b" (?:" + rule.pattern.encode() + b")(?= )", joined)]
    kept = []
    for start, end, rule in sorted(set(found), key=lambda x: (x[2].priority, x[0] - x[1], x[0], x[2].label)):
        if not any(a <= start and end <= b for a, b, _ in kept):
            kept.append((start, end, rule))
    base = {label for phrase, label in license_scan.BASE if f" {phrase} ".encode() in joined}
    return base | {r.label for _, _, r in kept}, max([0.5 if base else 0.0, *(r.weight for _, _, r in kept)])


def scanned(texts):
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(r) for r in raw]))
    out = license_scan._scan_slice(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, license_scan.RULES)
    return [({x for x in labels.split(",") if x}, score) for labels, score in zip(out["labels"], out["score"])]


def test_gates_and_containment_change_no_label():
    rng = random.Random(3)
    pick = lambda p: re.sub(r"\[(\w)\w*\]|\(\?:([^()|]*)[^()]*\)\??| \?|(\w)\?|\.\{\d+,\d+\}\?", lambda m: m[1] or (m[2] if rng.random() < 0.6 else "") or (m[3] or "") if m[0] != " ?" else " ", p)
    samples = [pick(pick(r.pattern)) for r in license_scan.RULES]
    texts = ["php 3.0 and elastic 2", *samples, *[" or ".join(rng.sample(samples, 6)) for _ in range(60)], " ".join(samples)]
    hit = 0
    for text, got in zip(texts, scanned(texts)):
        assert got == slow_labels(text, license_scan.RULES), text
        hit += bool(got[0])
    assert hit > 0.9 * len(texts)
    assert scanned(texts[:1])[0][0] == {"php-3.0", "elastic-2"}


@given(st.sampled_from(license_scan.RULES).flatmap(lambda r: st.from_regex(re.compile(r.pattern, re.ASCII), fullmatch=True)))
@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
def test_a_match_of_a_rule_needs_no_gate(text):
    assert scanned([text])[0] == slow_labels(text, license_scan.RULES)


def test_license_scan_of_a_very_long_text():
    text = "under the mit license or gpl 3 all rights reserved " * 20_000
    (labels, _), = scanned([text])
    assert labels == {"mit", "gpl-3", "reserved"}


def test_media(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(None, "no id"), (3, "a"), (3, "a"), (200, "x" * 64), (201, "y" * 65), (None, None)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra)
    want = Counter()
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        stored = media.encode_media(payload)
        assert media.decode_media(stored) == payload
        want[(r.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media._feature(payload), (1, 3), (f"{len(data)} bytes of text", f"64 bytes of {len(payload)}"))] += 1
    rows = media.text_media(docs).collect()
    assert Counter((*tuple(r)[:8], tuple(r.positions), tuple(r.captions)) for r in rows) == want
    assert media.text_media(no_docs).collect() == []


def test_feature_of_known_samples():
    assert media._feature(bytes(64)) == "64x1;mean=0.000;sd=0.000;edge=0.000;levels=1.000/0.000/0.000/0.000/0.000/0.000/0.000/0.000"
    assert media._feature(bytes([0, 255] * 32)).startswith("64x1;mean=127.500;sd=127.500;edge=255.000;levels=0.500/")


def test_page_sequences(spark):
    page = "<p>one</p><figure><img src=u1><figcaption>first</figcaption></figure><p>two</p><img src=u2 alt=second><video src=u1></video>"
    df = spark.createDataFrame([(1, page, "z"), (1, page, "z"), (2, None, "z"), (None, "<p>three", "z")], "page_id long, html string, _row string")
    store = spark.createDataFrame([("u1", 7)], "media_ref string, size int")
    got = sorted(((r.page_id or 0, r["items"], r.text_items, r.media_items, r.resolved_items, r.outline) for r in media.page_sequences(df, store).collect()))
    want = (1, 5, 2, 3, 2, "1:image:first|3:image:second|4:video")
    assert got == [(0, 1, 1, 0, 0, ""), want, want, (2, 0, 0, 0, 0, "")]
    by = {r.page_id: r.text_sha256 for r in media.page_sequences(df).collect()}
    assert by[1] == hashlib.sha256(b"one\ntwo").hexdigest() and by[2] == hashlib.sha256(b"").hexdigest()


def test_interleaved_pages(spark):
    page = "<html><head><title>t</title></head><body><h1>T</h1><p>a <b>b</b> &amp; c<figure><img src=u1><figcaption>cap <i>tion</i></figcaption></figure>tail<img src=u2 alt=alt2><script>no()</script><img><p>end"
    df = spark.createDataFrame([(1, page, "z"), (2, None, "z"), (3, "", "z"), (4, "<figure><figcaption>alone", "z"), (1, page, "z")], "page_id long, html string, items string")
    got = {r.id: [(i.position, i.kind, i.text, i.media_ref, i.caption) for i in r["items"]] for r in media.interleave(df).collect()}
    assert got[1] == [(0, "text", "T", None, None), (1, "text", "a b & c", None, None), (2, "image", None, "u1", "cap tion"), (3, "text", "tail", None, None), (4, "image", None, "u2", "alt2"), (5, "text", "end", None, None)]
    assert got[2] == [] and got[3] == [] and got[4] == [(0, "text", "alone", None, None)]
    refs = media.references(media.interleave(df.limit(1)))
    store = spark.createDataFrame([("u1", 7)], "media_ref string, size int")
    assert sorted((r.position, r.media_ref, r.caption, r.size) for r in media.resolve(refs, store).collect()) == [(2, "u1", "cap tion", 7), (4, "u2", "alt2", None)]


def brute_katz(docs):
    texts = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["</s>"] for i, t in docs}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    u = Counter(w for i in train for w in texts[i])
    b = Counter(p for i in train for p in zip(["</s>", *texts[i][:-1]], texts[i]))
    total = sum(u.values())

    def factors(counts):
        return katz.discounts(np.bincount([c for c in counts.values() if c <= 6], minlength=7))

    fu, fb = factors(u), factors(b)
    cut = lambda f, c: (f[c] if c <= 5 else 1.0) * c
    scale = 1.0
    unknown = 1 - sum(cut(fu, c) for c in u.values()) / total
    if unknown < 1e-12:
        scale, unknown = total / (total + 1), 1 / (total + 1)
    p1 = {w: cut(fu, c) / total * scale for w, c in u.items()}
    follow = defaultdict(list)
    for (h, w), c in b.items():
        follow[h].append((w, c))
    alpha, kept = {}, {}
    for h, f in follow.items():
        left = 1 - sum(cut(fb, c) for _, c in f) / u[h]
        kept[h] = 1.0
        if left < 1e-12:
            kept[h], left = u[h] / (u[h] + 1), 1 / (u[h] + 1)
        alpha[h] = left / (1 - sum(p1[w] for w, _ in f))

    def p(h, w):
        c = b.get((h, w), 0)
        return cut(fb, c) / u[h] * kept[h] if c else alpha.get(h, 1.0) * p1.get(w, unknown)

    for h in follow:  # exactly normalised
        assert abs(sum(p(h, w) for w in u) + p(h, "never seen") - 1) < 1e-9
    out = {}
    for i, ws in texts.items():
        base = sum(math.log10((u[w] + 0.1) / (total + 0.1 * (len(u) + 1))) for w in ws)
        out[i] = (zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(w in u for w in ws), total, base, sum(math.log10(p(h, w)) for h, w in zip(["</s>", *ws[:-1]], ws)))
    return out


def test_katz(spark, odd_docs, no_docs):
    want = brute_katz([(r.doc_id, r.text) for r in odd_docs.collect()])
    rows = katz.katz_scores(odd_docs).collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score == pytest.approx(w[5], rel=1e-9)
    assert katz.katz_scores(no_docs).collect() == []


def test_katz_without_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b a"), (1, "a b a"), (None, "a c"), (None, None)], "doc_id long, text string")
    rows = katz.katz_scores(df).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (0, 3), (1, 4), (1, 4)]
    assert len({r.score for r in rows if r.doc_id == 1}) == 1


def test_byte_planes_round_trip():
    a, b = np.array([1, -5, 2**40]), np.array([0.5, -1e300])
    got = katz.expand(katz.squeeze(a=a, b=b, c=np.zeros(0, np.int32)))
    assert got[0].tolist() == a.tolist() and got[1].tolist() == b.tolist() and got[2].tolist() == []


def _labelled(spark):
    rng = random.Random(1)
    syllables = ["ka", "to", "mi", "ren", "sol", "ver", "an", "du"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    insults = ["idiot", "worthless", "scumbag", "pathetic"]
    rows = []
    for i in range(1200):
        w = [word() for _ in range(60)]
        toxic = int(i % 4 == 0)
        if toxic:
            for p in rng.sample(range(60), 5):
                w[p] = rng.choice(insults)
        rows.append((i, " ".join(w), toxic))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (5001, "", "x")], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), {i: y for i, _, y in rows}


def test_toxicity_on_held_out_rows(spark, no_docs):
    docs, labels, truth = _labelled(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 1203
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    empty = {r.score for r in rows if r.doc_id >= 5000}
    assert len(empty) == 1 and 0 <= empty.pop() < 0.5
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(no_docs, labels).collect() == []


def test_toxicity_without_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(odd_docs, none).collect()} == {0.0}


def test_toxicity_of_few_labels_and_odd_rows(spark):
    long = "plain words in a row " * 40_000
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(5))
    said = lambda toxic: " ".join([word(), word(), "idiot" if toxic else word(), word(), word(), "worthless" if toxic else word()] * 3)
    rows = [(i, said(i < 10), "s", 0) for i in range(30)] + [(100, long, "s", 0), (None, "you idiot", "s", 0), (None, None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(30)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 33 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got if r.doc_id is not None}
    assert sum(by[i] for i in range(10)) / 10 > sum(by[i] for i in range(10, 30)) / 20
    assert toxicity.fit([(1, "a", 1), (2, "b", 0), (3, "c", 0)], 0.3) == 0.3


def test_dictionaries_are_trained_on_both_classes():
    rng = random.Random(2)
    plain = [" ".join(rng.choice(["alder", "birch", "cedar", "maple", "poplar", "willow"]) for _ in range(80)) for _ in range(120)]
    toxic = [t.replace("maple", "scoundrel", 3) for t in plain[:60]]
    marks = toxicity._marks(toxicity._contexts(toxic), toxicity._contexts(plain[60:]))
    assert marks[0] == b"scoundrel "  # the word with its end
    unit = toxicity._carried_unit(marks)
    assert unit(b"scoundrel") == b"scoundrel" and unit(b"cedar") == b""
    content = toxicity._toxic_content(toxic, unit)
    assert b"scoundrel" in content and b"scoundrel" not in toxicity._ordinary_content(plain + toxic[:5], unit)


def test_an_ordinary_word_may_begin_insults():
    rng = random.Random(3)
    words = ["alder", "birch", "cedar", "maple", "poplar", "willow"]
    said = lambda extra: " ".join(rng.choice([*words, *extra]) for _ in range(80))
    plain, toxic = [said(["baral"]) for _ in range(80)], [said(["baralgo", "baralix", "baralum"]) for _ in range(80)]
    unit = toxicity._carried_unit(toxicity._marks(toxicity._contexts(toxic), toxicity._contexts(plain)))
    assert all(unit(w) for w in (b"baralgo", b"baralix", b"baralum")) and not unit(b"baral") and not unit(b"maple")


def test_calibration_rows_made_no_dictionary(monkeypatch):
    rng = random.Random(4)
    said = lambda extra: " ".join(rng.choice(["alder", "birch", "cedar", "maple", *extra]) for _ in range(40))
    rows = [(i, said(["scoundrel"] if i % 4 == 0 else ["poplar"]), int(i % 4 == 0)) for i in range(400)]
    trained, scored = [], []
    contents, features = toxicity._contents, toxicity._all_features
    monkeypatch.setattr(toxicity, "_contents", lambda a, b, c: trained.extend(a + b) or contents(a, b, c))
    monkeypatch.setattr(toxicity, "_all_features", lambda t, c: scored.extend(t) or features(t, c))
    model = toxicity.fit(rows, 0.25)
    assert isinstance(model, toxicity.Model) and not set(trained) & set(scored) and len(trained) + len(scored) == 400
