"""Exact token counts from counts of distinct pre-tokens.

A tokenizer never merges across pre-tokens, so a document's length is the sum over its
pre-tokens of frequency x pieces.  Each task splits its documents into blocks and keeps,
per block, the distinct pre-tokens and every document's frequencies as integers.
Distinct pre-tokens meet by hash bucket, where each is cut into pieces once for the
whole corpus; the piece counts return to the blocks, one small integer per distinct
pre-token, and are summed against the frequencies.  No ids are ever materialised.

A task holds one block, so blocks are small, and a block's frequencies travel as
compressed bytes: lists of them would fill the executor's heap as they are read.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bucket_count, documents, flat, materialize, texts

#: A block closes at so many distinct pre-tokens or so many bytes of text.
BLOCK_TERMS = 1 << 17
BLOCK_BYTES = 16 << 20
#: What ``\\s`` means to the tokenizer, beyond the ASCII separators.
_WIDE_SPACE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_NARROW_SPACE = "\t\n\x0b\x0c\r"


class Splitter:
    """Pre-tokens of a tokenizers file that lower-cases, drops white space and splits by a pattern."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.marks = [t["content"] for t in spec["added_tokens"]]

    def units(self, text: str) -> tuple[int, list[str]]:
        """(special strings in the text, runs without white space in normal form)."""
        specials = 0
        parts = [text]
        if any(m in text for m in self.marks):
            parts = self.special.split(text)
            specials = len(parts) - 1
        units: list[str] = []
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
                for c in _WIDE_SPACE:
                    if c in part:
                        part = part.replace(c, " ")
                # lower case by character: a final sigma has no form of its own here
                part = part.replace("Σ", "σ")
            for c in _NARROW_SPACE:
                part = part.replace(c, " ")
            units += part.lower().split(" ")
        return specials, units

    def pretokens(self, unit: str) -> list[str]:
        return self.pattern.findall(unit)


@functools.cache
def _splitter(path: str) -> Splitter:
    return Splitter(path)


@functools.cache
def _piece_counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """Pieces of each pre-token: the file's model alone, without normaliser and splitting."""
    from tokenizers import Tokenizer, pre_tokenizers

    model = Tokenizer(Tokenizer.from_file(path).model)
    model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def count(words: pa.Array) -> np.ndarray:
        out = np.empty(len(words), dtype=np.int32)
        for i in range(0, len(words), 4096):
            out[i : i + 4096] = [len(e) for e in model.encode_batch_fast(words[i : i + 4096].to_pylist(), add_special_tokens=False)]
        return out

    return count


class _Block:
    def __init__(self):
        self.name = uuid.uuid4().hex
        self.units: dict[str, int] = {}
        self.unit_terms = array("i")
        self.unit_ends = array("i", [0])
        self.terms: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.size: list[int] = []
        self.special: list[int] = []
        self.docs: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id, data: bytes, split: Splitter) -> None:
        special, units = split.units(data.decode())
        known = self.units
        get = known.get
        seq = list(map(get, units))
        if None in seq:
            terms = self.terms
            for u in units:
                if u not in known:
                    known[u] = len(known)
                    self.unit_terms.extend([terms.setdefault(t, len(terms)) for t in split.pretokens(u)])
                    self.unit_ends.append(len(self.unit_terms))
            seq = list(map(get, units))
        self.ids.append(doc_id)
        self.size.append(len(data))
        self.special.append(special)
        self.docs.append(np.array(seq, dtype=np.int32))
        self.bytes += len(data)

    def full(self) -> bool:
        return len(self.terms) >= BLOCK_TERMS or self.bytes >= BLOCK_BYTES

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """The block's frequencies, then its distinct pre-tokens by bucket.

        Pre-tokens are numbered in bucket order, so counts return as plain lists.
        """
        words = list(self.terms)
        bucket = np.array([zlib.crc32(w.encode()) % buckets for w in words], dtype=np.int32)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(words), dtype=np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        starts = np.array(self.unit_ends, dtype=np.int64)
        n_units = np.diff(starts)
        all_terms = rank[np.array(self.unit_terms, dtype=np.int32)]
        doc_terms, doc_freq, doc_len = [], [], []
        for seq in self.docs:
            reps = n_units[seq]
            at = np.arange(int(reps.sum())) - np.repeat(np.append(0, np.cumsum(reps))[:-1], reps) + np.repeat(starts[seq], reps)
            t, k = np.unique(all_terms[at], return_counts=True)
            doc_terms.append(t)
            doc_freq.append(k.astype(np.int32))
            doc_len.append(len(t))
        keys, first = np.unique(bucket[order], return_index=True)
        gaps = np.diff(np.concatenate([*doc_terms, np.zeros(0, np.int32)]), prepend=0)
        freqs = np.concatenate([*doc_freq, np.zeros(0, np.int32)])
        yield _rows(self.name, [-1], {"ids": self.ids, "sizes": self.size, "special": self.special, "lens": doc_len, "gaps": _packed(gaps), "freqs": _packed(freqs)})
        yield _rows(self.name, keys, {"words": [words[i] for i in order.tolist()]}, np.append(first, len(words)))


def _packed(values: np.ndarray) -> bytes:
    """32-bit integers by byte planes, compressed: the upper planes of small ones are next to nothing."""
    return pa.Codec("zstd", 1).compress(values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int32)
    planes = pa.Codec("zstd").decompress(data, decompressed_size=4 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<i4").ravel()


_BLOCKS = "block string, bucket int, ids array<bigint>, sizes array<bigint>, special array<int>, lens array<int>, gaps binary, freqs binary, words array<string>"
_LISTS = {"ids": pa.int64(), "sizes": pa.int64(), "special": pa.int32(), "lens": pa.int32(), "gaps": None, "freqs": None, "words": pa.string()}


def _rows(block: str, buckets, lists: dict, offsets=None) -> pa.RecordBatch:
    """A row for each bucket, whose lists begin at ``offsets``; without those one row has all."""
    columns = {"block": pa.array([block] * len(buckets), pa.string()), "bucket": pa.array(buckets, pa.int32())}
    for name, kind in _LISTS.items():
        if kind is None:
            columns[name] = pa.array([lists.get(name)] * len(buckets), pa.binary())
        elif name in lists:
            values = pa.array(lists[name], type=kind)
            columns[name] = pa.ListArray.from_arrays(pa.array([0, len(values)] if offsets is None else offsets, pa.int32()), values)
        else:
            columns[name] = pa.nulls(len(buckets), pa.list_(kind))
    return pa.RecordBatch.from_pydict(columns)


def _blocks(batches: Iterator[pa.RecordBatch], path: str, buckets: int) -> Iterator[pa.RecordBatch]:
    split, block = _splitter(path), _Block()
    for batch in batches:
        for doc_id, data in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            block.add(doc_id, data, split)
            if block.full():
                yield from block.rows(buckets)
                block = _Block()
    if block.ids:
        yield from block.rows(buckets)


def _count(table: pa.Table, path: str) -> pa.Table:
    """Pieces of every distinct pre-token of one bucket, returned to each asking block."""
    words = table.column("words").combine_chunks()
    values = words.flatten() if not isinstance(words, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in words.chunks])
    coded = values.dictionary_encode()
    pieces = _piece_counter(path)(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "pieces": pa.ListArray.from_arrays(_offsets(words), pa.array(pieces, pa.int32()))})


def _offsets(column) -> pa.Array:
    import pyarrow.compute as pc

    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return pa.array(np.append(0, np.cumsum(n)).astype(np.int32))


_COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def _sum(block: pa.Table, counts: pa.Table) -> pa.Table:
    pieces = flat(counts.sort_by("bucket"), "pieces")
    ids, sizes, special = (flat(block, c) for c in ("ids", "sizes", "special"))
    lens = flat(block, "lens")
    gaps, freqs = (_unpacked(block.column(c)[0].as_py(), int(lens.sum())) for c in ("gaps", "freqs"))
    terms = np.cumsum(gaps, dtype=np.int64)
    total = np.append(0, np.cumsum(pieces[terms].astype(np.int64) * freqs)) if len(terms) else np.zeros(1, np.int64)
    at = np.append(0, np.cumsum(lens))
    column = block.column("ids").combine_chunks()
    ids = column.flatten() if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return pa.table({"doc_id": ids.cast(pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(total[at[1:]] - total[at[:-1]] + special, pa.int64())})


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens of the whole text.

    ``tokenizer`` is the path of a tokenizers file whose pre-tokenizer drops white space,
    present on every executor.  Added special strings in a text count as their one token,
    as the library does by default.  Null and empty texts have 0 bytes and 0 tokens;
    repeated rows and rows without id each give their own row; an empty table gives an
    empty table; other columns are ignored.  Very long texts close a block early; a block
    is the only thing that one task holds whole.
    """
    spark = docs.sparkSession
    buckets = bucket_count(docs, 1)
    blocks = materialize(documents(docs, id_col, text_col).mapInArrow(lambda it: _blocks(it, tokenizer, buckets), _BLOCKS), "token-blocks")
    asked = blocks.filter("bucket >= 0").select("block", "bucket", "words")
    counted = asked.groupBy("bucket").applyInArrow(lambda t: _count(t, tokenizer), "block string, bucket int, pieces array<int>")
    counted = materialize(counted, "token-pieces")
    whole = blocks.filter("bucket < 0").select("block", "ids", "sizes", "special", "lens", "gaps", "freqs")
    return whole.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_sum, _COUNTS)


#: Tokens above which a document does not fit one training sequence.
LIMIT = 2048


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
