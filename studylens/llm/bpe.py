"""Byte-level BPE encoding and decoding with contiguous rank arrays.

A short word is a row of parts and a row of the ranks of adjacent pairs.  Each step
scans the row for its smallest rank, deletes the boundary there and refreshes the two
neighbouring ranks.  Words of one length share a matrix, so numpy takes the same step
for thousands of distinct words at once; words longer than SHORT use a heap instead,
because scanning long rows is quadratic.

Texts are cut where a single space precedes a word: the pre-tokenizer always cuts
there, and most such chunks have been seen before, so encoding is mostly look-up.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, texts

SHORT = 48
#: Chunks that a task remembers before it starts afresh.
MEMORY = 1_200_000
_NONE = np.iinfo(np.int32).max
_WIDE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class BytePairCodec:
    """Encoder and decoder of a byte-level BPE vocabulary file (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pairs.append((vocab[left] << 32 | vocab[right], rank, vocab[left + right]))
        pairs.sort()
        self.keys, self.ranks, self.merged = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        self.ranks = self.ranks.astype(np.int32)
        self.lookup = {k: (r, m) for k, r, m in pairs}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in vocab.items():
            if token not in self.specials:
                self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.pieces = regex.compile(_PATTERN)
        self.cut = regex.compile(r" (?=\S)")
        self.piece_memory: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}
        self.lead: dict[str, bytes] = {}

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE).astype(np.int32), self.merged[at]

    def _short(self, words: list[bytes]) -> list[bytes]:
        """Words of one length: parts and adjacent ranks as matrices."""
        n, size = len(words), len(words[0])
        parts = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)].reshape(n, size)
        ranks, into = self._ranks_of(parts[:, :-1], parts[:, 1:])
        rows = np.arange(n)
        out: list[bytes] = [b""] * n
        while True:
            width = parts.shape[1]
            best = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), dtype=np.int64)
            live = ranks[np.arange(len(rows)), best] != _NONE if width > 1 else np.zeros(len(rows), dtype=bool)
            if not live.all():
                done = parts[~live].astype(np.uint32)
                for r, ids in zip(rows[~live].tolist(), done):
                    out[r] = ids.tobytes()
                if not live.any():
                    return out
                parts, ranks, into, rows, best = parts[live], ranks[live], into[live], rows[live], best[live]
            # delete the boundary after part `best`: everything behind moves one place left
            at = np.arange(len(rows))
            joined = into[at, best]
            behind = np.arange(width - 1) > best[:, None]
            parts = np.where(behind, parts[:, 1:], parts[:, :-1])
            parts[at, best] = joined
            behind = behind[:, : width - 2]
            ranks, into = (np.where(behind | (np.arange(width - 2) >= best[:, None]), x[:, 1:], x[:, :-1]) for x in (ranks, into))
            if width == 2:
                ranks = into = np.zeros((len(rows), 0), dtype=np.int64)
                continue
            for side in (best - 1, best):
                ok = (side >= 0) & (side < width - 2)
                r, c = at[ok], side[ok]
                ranks[r, c], into[r, c] = self._ranks_of(parts[r, c], parts[r, c + 1])

    def _long(self, word: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.lookup[k], i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := ids[i] << 32 | ids[i + 1]) in self.lookup]
        heap = [(r, i, m, a, b) for r, m, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, m, a, b = heapq.heappop(heap)
            j = after[i] if i < n else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (found := self.lookup.get(ids[p] << 32 | ids[q])):
                    heapq.heappush(heap, (found[0], p, found[1], ids[p], ids[q]))
        return np.array([x for x in ids if x >= 0], dtype=np.uint32).tobytes()

    def _learn_pieces(self, pieces: set[str]) -> None:
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            data = p.encode()
            by_size.setdefault(len(data), []).append((p, data))
        for size, group in by_size.items():
            if size > SHORT:
                ids = [self._long(d) for _, d in group]
            elif size == 1:
                ids = [self.byte_ids[d[0]].astype(np.uint32).tobytes() for _, d in group]
            else:
                ids = [x for i in range(0, len(group), 20_000) for x in self._short([d for _, d in group[i : i + 20_000]])]
            self.piece_memory.update(zip((p for p, _ in group), ids))

    def _split(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk; plain words, with or without a mark behind, need no pattern."""
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return [chunk]
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pieces.findall(chunk)

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks, as little-endian unsigned 32-bit integers."""
        found = {c: self._split(c) for c in chunks}
        self._learn_pieces({p for ps in found.values() for p in ps} - self.piece_memory.keys())
        memory = self.piece_memory
        return {c: b"".join([memory[p] for p in ps]) for c, ps in found.items()}

    def _chunks(self, text: str) -> list[str]:
        plain = "  " not in text and text[-1:] != " " and not any(s in text for s in (" \n", " \t", " \r", " \x0b", " \x0c"))
        if plain and not text.isascii():
            plain = not any(s in text for s in _WIDE)
        return text.split(" ") if plain else self.cut.split(text)

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Ids of every text as bytes (little-endian uint32), special strings as their ids."""
        if len(self.inner) + len(self.lead) > MEMORY:
            self.inner, self.lead = {}, {}
        if len(self.piece_memory) > MEMORY // 2:
            self.piece_memory = {}
        plans: list[list[list[str] | bytes]] = []
        new_lead, new_inner = set(), set()
        for text in batch:
            parts = [text]
            if self.special_split is not None and any(s in text for s in self.specials):
                parts = self.special_split.split(text)
            plan: list[list[str] | bytes] = []
            for i, part in enumerate(parts):
                if i % 2:
                    plan.append(np.uint32(self.specials[part]).tobytes())
                elif part:
                    chunks = self._chunks(part)
                    new_lead.add(chunks[0])
                    new_inner.update(chunks[1:])
                    plan.append(chunks)
            plans.append(plan)
        new_lead -= self.lead.keys()
        new_inner -= self.inner.keys()
        if new_lead:
            self.lead |= self._learn(new_lead)
        if new_inner:
            learned = self._learn({" " + c for c in new_inner})
            self.inner.update((c[1:], ids) for c, ids in learned.items())
        out, lead, inner = [], self.lead, self.inner
        for plan in plans:
            ids: list[bytes] = []
            for part in plan:
                if isinstance(part, bytes):
                    ids.append(part)
                else:
                    ids.append(lead[part[0]])
                    ids += map(inner.__getitem__, part[1:])
            out.append(b"".join(ids))
        return out

    def decode_bytes(self, ids: bytes) -> bytes:
        """UTF-8 bytes of the ids; sequences that are not UTF-8 become replacement marks."""
        data = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            return data.decode(errors="replace").encode()


@functools.cache
def codec(path: str) -> BytePairCodec:
    return BytePairCodec(path)


def encoded(column: pa.Array, path: str, step: int = 2048) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, ids of each text) for some texts at a time."""
    coder, group, at = codec(path), [], 0
    for i, data in enumerate(texts(column)):
        group.append(data.decode())
        if len(group) == step:
            yield at, coder.encode_batch(group)
            group, at = [], i + 1
    if group:
        yield at, coder.encode_batch(group)


_CODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = codec(path)
    for batch in batches:
        n, ids_sha, text_sha = [], [], []
        for _, group in encoded(batch.column(1), path):
            for ids in group:
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids array<int>.

    ``tokenizer`` is a byte-level BPE file with the GPT-2 pre-tokenizer, present on every
    executor.  Special strings in a text become their ids.  Null and empty texts have no
    ids; repeated rows and rows without id stay; an empty table gives an empty table;
    other columns are ignored.  Narrow: no shuffle.
    """

    def run(batches):
        for batch in batches:
            ids = [x for _, group in encoded(batch.column(1), tokenizer) for x in group]
            offsets = pa.array(np.append(0, np.cumsum([len(x) // 4 for x in ids])).astype(np.int32))
            values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "ids"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text of a table (doc_id, ids array<int>); null ids give an empty text."""

    def run(batches):
        coder = codec(tokenizer)
        for batch in batches:
            out = [coder.decode_bytes(np.array(x or [], dtype=np.uint32).tobytes()).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them.

    Same rules as ``encode``; ids and texts stay inside the task.
    """
    return documents(docs, id_col, text_col).mapInArrow(lambda it: _digests(it, tokenizer), _CODED)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
