"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text.  A
document is cut into overlapping windows of a few words; a window that compresses better
with the toxic dictionary speaks for toxicity by the bytes saved.  Thresholds on that
saving are calibrated on labelled documents that the dictionaries never saw: a logistic
model weighs how many windows save 1, 2, ... 8 bytes or more.

Most of a toxic text is ordinary, and zstandard's trainer goes by frequency alone, so on
whole toxic texts it learns ordinary syllables.  The segments that it is trained on are
therefore chosen first: the words and word beginnings of toxic documents whose contexts
are too many, against ordinary documents, for chance.  The toxic side compresses with
both dictionaries, its own one farther away, so that windows without such a segment cost
the same on both sides.  Every window stands behind a fixed carrier that both sides hold;
without it, zstandard's block overhead swallows savings of a few bytes.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_mod, documents
from .words import SLICE_BYTES, text_buffers

WINDOW_WORDS, STEP_WORDS = 4, 2
SAVINGS = 8
#: The lowest level that looks through whole chains of candidates in a dictionary.
LEVEL = 5
#: Sizes that zstandard's trainer is given; it fills what its samples are worth.
TOXIC_DICT, ORDINARY_DICT = 2048, 6144
#: Bound of the labelled sample that the model is fitted on, by class.
SAMPLE = {1: 1500, 0: 3000}
#: A segment is chosen if chance would give so many of all candidates its contexts.
CHANCE = 0.05
#: A chosen segment is so many times as common in toxic documents as in ordinary ones.
MARK_RATE = 5.0
#: Segments are words with their end and beginnings of words, of these lengths in bytes.
STEMS = range(4, 9)
#: Share of the labelled texts, by their hash, that the dictionaries are trained on; the others calibrate.
TRAINED_SHARE = 0.6
#: Words of one sample of the ordinary dictionary.
ORDINARY_WORDS = 12
#: Clean documents that the cut of ``drop_toxic`` may at most lose, by calibration.
CLEAN_LOST = 0.03
CARRIER = bytes(range(1, 25))  # control characters never occur in a window

_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    #: Score from which a filter drops a document, chosen on calibration rows.
    cut: float


def _clean(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with single spaces; every document starts behind a space and ends with one."""
    n = len(data)
    gap = np.arange(len(offsets) - 1) + offsets[1:]
    out = np.full(n + len(offsets) - 1, 32, dtype=np.uint8)
    body = np.ones(len(out), dtype=bool)
    body[gap] = False
    out[body] = _LETTER[data]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    if len(out):
        keep[0] = out[0] != 32
    shift = np.append(0, np.cumsum(keep))
    return out[keep], shift[np.append(0, gap + 1)]


def _windows(first: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document) of overlapping windows with the space before them; short documents are one window."""
    ends = np.flatnonzero(text == 32) + 1
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    at = np.searchsorted(starts, first)  # first word of each document
    n_words = np.diff(at)
    doc = np.repeat(np.arange(len(first) - 1), n_words)
    rank = np.arange(len(doc)) - at[doc]
    mine = np.flatnonzero((rank % STEP_WORDS == 0) & ((rank + WINDOW_WORDS < n_words[doc] + STEP_WORDS) | (rank == 0)))
    doc = doc[mine]
    last = np.minimum(mine + WINDOW_WORDS, at[doc + 1]) - 1
    start = np.maximum(starts[mine] - 1, 0)
    return start, ends[last] - start, doc


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    out = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    out.precompute_compress(level=LEVEL)
    return out


def _carried(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[bytes, bytes]:
    """The windows, each behind the carrier, and their spans."""
    lead = np.frombuffer(CARRIER, dtype=np.uint8)
    whole = size + len(lead)
    first = np.cumsum(whole) - whole
    out = np.empty(int(whole.sum()), dtype=np.uint8)
    out[(first[:, None] + np.arange(len(lead))).ravel()] = np.tile(lead, len(first))
    body = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    into = np.arange(len(body)) + np.repeat((np.arange(len(first)) + 1) * len(lead), size)
    out[into] = text[body]
    return out.tobytes(), np.stack([first, whole], axis=1).astype(np.uint64).tobytes()


def _sizes(data: bytes, spans: bytes, dictionary: zstandard.ZstdCompressionDict) -> np.ndarray:
    tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)
    found = tool.multi_compress_to_buffer(zstandard.BufferWithSegments(data, spans), threads=0)
    return np.fromiter(map(len, found), dtype=np.int32, count=len(found))


def _features(data: np.ndarray, offsets: np.ndarray, toxic, ordinary) -> np.ndarray:
    """Per document: log counts of windows by bytes saved, largest and mean saving, log size."""
    text, first = _clean(data, offsets)
    n_docs = len(first) - 1
    out = np.zeros((n_docs, SAVINGS + 3))
    start, size, doc = _windows(first, text)
    if not len(start):
        return out
    raw, spans = _carried(text, start, size)
    saved = _sizes(raw, spans, ordinary) - _sizes(raw, spans, toxic)
    for t in range(1, SAVINGS + 1):
        out[:, t - 1] = np.log1p(np.bincount(doc[saved >= t], minlength=n_docs))
    count = np.bincount(doc, minlength=n_docs)
    most = np.full(n_docs, -(1 << 20))
    np.maximum.at(most, doc, saved)
    out[:, SAVINGS] = np.where(count > 0, most, 0)
    out[:, SAVINGS + 1] = np.bincount(doc, weights=saved, minlength=n_docs) / np.maximum(count, 1)
    out[:, SAVINGS + 2] = np.log1p(count)
    return out


def _batch_features(data: np.ndarray, offsets: np.ndarray, toxic, ordinary) -> np.ndarray:
    parts, row, rows = [np.zeros((0, SAVINGS + 3))], 0, len(offsets) - 1
    while row < rows:
        stop = min(rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1))
        parts.append(_features(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], toxic, ordinary))
        row = stop
    return np.concatenate(parts)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)


def _words_of(text: str) -> list[bytes]:
    return _LETTER[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes().split()


def _units(word: bytes) -> list[bytes]:
    """The word with its end, and its beginnings: an ordinary word may begin insults without being one."""
    return [word + b" ", *[word[:k] for k in STEMS if k < len(word)]]


def _contexts(texts: list[str], among: Counter | None = None) -> tuple[Counter, int]:
    """How many different contexts each unit has, and how many contexts there are.

    A context is a word with both neighbours.  Copies of a text have the same ones, so
    a word that copies repeat does not look frequent.
    """
    seen: set[int] = set()
    whole: Counter = Counter()
    for text in texts:
        words = [b"", *_words_of(text), b""]
        for i in range(1, len(words) - 1):
            key = hash((words[i - 1], words[i], words[i + 1]))
            if key in seen:
                continue
            seen.add(key)
            whole[words[i]] += 1
    found: Counter = Counter()
    for word, n in whole.items():
        for unit in _units(word):
            if among is None or unit in among:
                found[unit] += n
    return found, len(seen)


def _marks(toxic: tuple[Counter, int], ordinary: tuple[Counter, int]) -> list[bytes]:
    """Units whose contexts lie in toxic documents beyond chance, the strongest first.

    Under chance a context of a unit is toxic with the share of all contexts that is; the
    log of the chance of at least so many is bounded by their relative entropy.  A stem
    gives way to a longer unit that has at least four fifths of its contexts.
    """
    (within, n1), (outside, n0) = toxic, ordinary
    q = n1 / (n1 + n0) if n1 else 1.0
    strength = {}
    for unit, c in within.items():
        if c < 2 or len(unit) < STEMS[0]:
            continue
        share = c / (c + outside[unit])
        if c * n0 > MARK_RATE * outside[unit] * n1:
            rest = (1 - share) * math.log((1 - share) / (1 - q)) if share < 1 else 0.0
            strength[unit] = (c + outside[unit]) * (share * math.log(share / q) + rest)
    longer: Counter = Counter()  # most contexts of a longer unit, by stem
    for unit in strength:
        for k in range(STEMS[0], len(unit)):
            longer[unit[:k]] = max(longer[unit[:k]], within[unit])
    ranked = sorted((u for u in strength if longer[u] < 0.8 * within[u]), key=lambda u: (-strength[u], u))
    need = math.log(max(len(strength), 1) / CHANCE)
    return [u for u in ranked if strength[u] > need]


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary that zstandard trains.

    It refuses a handful of samples; then these, each once, are the dictionary.
    """
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))


def _carried_unit(marks: list[bytes]) -> Callable[[bytes], bytes]:
    """The longest chosen segment that a word ends or begins with, without its end; empty if none."""
    chosen = set(marks)
    return functools.cache(lambda word: max((u for u in _units(word) if u in chosen), key=len, default=b"").strip())


def _toxic_content(texts: list[str], unit: Callable[[bytes], bytes]) -> bytes:
    """Trained on the chosen segments of every toxic document, in their order."""
    samples = []
    for text in texts:
        if found := [u for u in map(unit, _words_of(text)) if u]:
            samples.append(b" " + b" ".join(found) + b" ")
    return _trained(samples, TOXIC_DICT)


def _ordinary_content(texts: list[str], unit: Callable[[bytes], bytes]) -> bytes:
    """Trained on pieces of ordinary documents, without words that carry a chosen segment, which would cancel it."""
    samples = []
    for text in texts:
        words = [w for w in _words_of(text) if not unit(w)]
        samples += [b" " + b" ".join(words[i : i + ORDINARY_WORDS]) + b" " for i in range(0, len(words), ORDINARY_WORDS)]
    return _trained(samples, ORDINARY_DICT)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features; what lies far outside the labelled texts, as a book's length, counts no further."""
    return np.clip((x - mean) / scale, -6, 6)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    a = np.c_[_standard(x, mean, scale), np.ones(len(x))]
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _contents(toxic: list[str], ordinary: list[str], counted: tuple) -> tuple[bytes, bytes]:
    """(content of the toxic side, content of the ordinary side)."""
    unit = _carried_unit(_marks(*counted))
    common = _ordinary_content(ordinary, unit)
    return _toxic_content(toxic, unit) + common, common


def _all_features(texts: list[str], contents: tuple[bytes, bytes]) -> np.ndarray:
    tools = [_dictionary(c) for c in contents]
    return np.concatenate([_batch_features(*_joined(texts[i : i + 200]), *tools) for i in range(0, len(texts), 200)])


def _cut(score: np.ndarray, y: np.ndarray) -> float:
    """The score from which recall and clean share sum highest, with at most CLEAN_LOST of the clean ones above."""
    order = np.argsort(-score, kind="stable")
    found, lost = np.cumsum(y[order]) / y.sum(), np.cumsum(1 - y[order]) / (1 - y).sum()
    ends = np.append(score[order][1:] < score[order][:-1], True)  # equal scores go together
    good = np.where(ends & (lost <= CLEAN_LOST), found - lost, -1.0)
    best = int(np.argmax(good))
    if good[best] <= 0:
        return 1.0
    below = score[order][best + 1] if best + 1 < len(score) else 0.0
    return float((score[order][best] + below) / 2)


def fit(rows: list[tuple[int, str, int]], share: float) -> Model | float:
    """Model from labelled (doc_id, text, toxic), or ``share`` where a class has fewer than two texts.

    TRAINED_SHARE of the texts, by their hash, so that copies stay together, train the
    dictionaries; thresholds and cut are calibrated on the scores that these very
    dictionaries give the others.  Where that leaves a class out on one side, each class
    is dealt by turns.  ``share`` is the toxic share of all labelled documents; the
    calibration rows' own share is corrected to it.
    """
    rows = sorted(rows)
    y = np.array([r[2] for r in rows], dtype=float)
    trains = np.array([zlib.crc32(t.encode()) % 1000 < 1000 * TRAINED_SHARE for _, t, _ in rows], dtype=bool)
    full = lambda side: all((y[side] == c).any() for c in (0, 1))
    if not (full(trains) and full(~trains)):
        for c in (0, 1):
            mine = np.flatnonzero(y == c)
            trains[mine] = np.arange(len(mine)) % 2 == 0
        if not (full(trains) and full(~trains)):
            return share
    part = {c: [rows[i][1] for i in np.flatnonzero(trains & (y == c))] for c in (0, 1)}
    toxic = _contexts(part[1])
    contents = _contents(part[1], part[0], (toxic, _contexts(part[0], toxic[0])))
    unseen = np.flatnonzero(~trains)
    x, y = _all_features([rows[i][1] for i in unseen], contents), y[unseen]
    mean, scale, weights = _logistic(x, y)
    weights[-1] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean())) if 0 < share < 1 else 0.0
    cut = _cut(_logistic_score(x, mean, scale, weights), y)
    return Model(*contents, tuple(mean), tuple(scale), tuple(weights), cut)


def _logistic_score(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_standard(x, mean, scale) @ weights[:-1] + weights[-1], -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> tuple[list[tuple[int, str, int]], float]:
    """(at most ``sample[y]`` documents of each class by the hash of their id, toxic share).

    Only ids with crc32(doc_id) mod 5 > 0 take part.  The chosen ids, bounded by the
    sample, are broadcast to the scan that fetches their texts; the share counts all.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    order = [F.xxhash64(F.col("doc_id").cast("long")), F.col("doc_id")]
    picked = None
    for y, most in (sample or SAMPLE).items():
        part = known.filter(F.col("toxic") == y).orderBy(*order).limit(most)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.join(F.broadcast(picked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))), "doc_id")
    return [(r[0], r[1] or "", r[2]) for r in rows.select("doc_id", "text", "toxic").toLocalIterator()], (toxic / total if total else 0.0)


def _scorer(model: Model | float) -> Callable[[pa.Array], np.ndarray]:
    """Scores of a text column; the dictionaries are prepared once per task."""
    if not isinstance(model, Model):
        return lambda column: np.full(len(column), model)
    toxic, ordinary = _dictionary(model.toxic), _dictionary(model.ordinary)
    mean, scale, weights = (np.array(x) for x in (model.mean, model.scale, model.weights))

    def score(column: pa.Array) -> np.ndarray:
        x = _batch_features(*text_buffers(column), toxic, ordinary)
        return _logistic_score(x, mean, scale, weights)

    return score


def score_documents(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score.  Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(score(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, model: Model | float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the model's cut, all columns as they are.  Narrow.

    Null and empty texts score as texts without evidence; repeated rows share their fate.
    Without a fitted model nothing is known against any row, and all stay.
    """
    if not isinstance(model, Model):
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at)) < model.cut))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Only text enters the score.  Null and empty texts have no window and get the score
    of a text without evidence.  Repeated rows get equal scores; an empty table gives an
    empty table; with fewer than two labelled documents of a class every score is the
    labelled share of toxic documents (0 without labels); other columns are ignored.
    """
    rows = documents(docs, id_col, text_col)
    model = fit(*labelled_sample(rows, labels))
    scored = score_documents(rows, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
