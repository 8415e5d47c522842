"""License scans: ordered signature rules behind a keyword gate.

A slice of documents is searched for each gate keyword once; only documents that hold a
rule's keyword are tried against the rule.  Of overlapping detections the lower priority
number wins, and a detection inside the interval of a stronger one is suppressed.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .license_rules import RULES, Rule
from .words import SLICE_BYTES, text_buffers

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True


@functools.cache
def _compiled(rules: tuple[Rule, ...]) -> dict[bytes, list[tuple[Rule, re.Pattern]]]:
    """Rules by the first word of their gate, which is what the raw text is searched for."""
    out: dict[bytes, list[tuple[Rule, re.Pattern]]] = {}
    for rule in rules:
        gate = rule.gate.split()[0].encode()
        out.setdefault(gate, []).append((rule, re.compile(b" (?:" + rule.pattern.encode() + b")(?= )")))
    return out


@functools.cache
def _base() -> list[tuple[re.Pattern, bytes, str]]:
    return [(re.compile(b" " + p.encode() + b"(?= )"), p.split()[0].encode(), label) for p, label in BASE]


def _resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that no stronger detection contains, strongest first.

    ``starts`` and ``ends`` are the kept intervals that no other kept one contains, both
    rising, so the last one that starts early enough decides.
    """
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    ends: list[int] = []
    for start, end, rule in sorted(set(found), key=lambda x: (x[2].priority, x[0] - x[1], x[0], x[2].label)):
        at = bisect.bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((start, end, rule))
        first = bisect.bisect_left(starts, start)
        last = bisect.bisect_right(ends, end)
        starts[first : max(first, last)], ends[first : max(first, last)] = [start], [end]
    return kept


def _scan(words: bytes, groups: list[list[tuple[Rule, re.Pattern]]]) -> tuple[list[tuple[int, str]], list[tuple[int, int, Rule]]]:
    """(base places, detections) in byte positions of the joined words."""
    base = [(m.start(), label) for pattern, _, label in _base() for m in pattern.finditer(words)]
    found = []
    for rules in groups:
        for rule, pattern in rules:
            if rule.gate.encode() in words:
                found += [(m.start(), m.end(), rule) for m in pattern.finditer(words)]
    return base, _resolve(found)


_RESULT = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def _holders(data: bytes, keyword: bytes, offsets: np.ndarray) -> set[int]:
    """Documents of the slice that hold the keyword."""
    out, at = set(), data.find(keyword)
    while at >= 0:
        doc = int(np.searchsorted(offsets, at, side="right")) - 1
        out.add(doc)
        at = data.find(keyword, int(offsets[doc + 1]))  # on to the next document
    return out


def _scan_slice(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...]) -> dict[str, list]:
    data = _LOWER[data]
    inside = _WORD[data]
    first = inside.copy()
    if len(data):
        edge = np.zeros(len(data), dtype=bool)
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        first[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(first)
    n_words = np.diff(np.searchsorted(starts, offsets))
    spaced = data.copy()
    spaced[~inside] = 32
    raw, spaced = data.tobytes(), spaced.tobytes()
    groups = _compiled(rules)
    wanted: dict[int, list[bytes]] = {}
    for gate in {*groups, *(g for _, g, _ in _base())}:
        for doc in _holders(raw, gate, offsets):
            wanted.setdefault(doc, []).append(gate)
    n = len(offsets) - 1
    out: dict[str, list] = {"n_words": n_words.tolist(), "n_base": [0] * n, "first_word": [None] * n, "last_word": [None] * n, "base_labels": [""] * n, "labels": [""] * n, "score": [0.0] * n}
    for doc, gates in wanted.items():
        joined = b" " + b" ".join(spaced[offsets[doc] : offsets[doc + 1]].split(b" ")) + b" "
        joined = re.sub(b" +", b" ", joined)
        base, found = _scan(joined, [groups[g] for g in sorted(gates) if g in groups])
        gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        places = np.searchsorted(gaps, [at for at, _ in base]).tolist()
        names = sorted({label for _, label in base})
        out["n_base"][doc] = len(base)
        if places:
            out["first_word"][doc], out["last_word"][doc] = min(places), max(places)
        out["base_labels"][doc] = ",".join(names)
        out["labels"][doc] = ",".join(sorted({*names, *(r.label for _, _, r in found)}))
        out["score"][doc] = max([0.5 if base else 0.0, *(r.weight for _, _, r in found)])
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_words, base phrase places, labels and a score.

    Base labels always stay in ``labels``; the rules add theirs.  ``score`` is the weight
    of the strongest detection.  Null and empty texts have no words and empty labels;
    ``first_word`` and ``last_word`` are null without base phrases.  Repeated rows and
    rows without id stay; an empty table gives an empty table; other columns are ignored.
    Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            row, rows = 0, batch.num_rows
            while row < rows:
                stop = min(rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1))
                found = _scan_slice(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], rules)
                kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row).cast(pa.int64()), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in found.items()]], names=["doc_id", *found])
                row = stop

    return documents(docs, id_col, text_col).mapInArrow(run, _RESULT)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
