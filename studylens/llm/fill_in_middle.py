"""Fill-in-middle transformation as a pipeline of pyarrow.compute steps.

A batch of texts becomes one flat array of units with the row each came from.  Ordinals
within the row tell every unit's role (before, middle, after); each role's units are
filtered out, listed again by row, and joined to one piece.  The pieces are put in the
order that the row's form asks for, between markers.

Units are cut on bytes: the separators are ASCII, so cutting UTF-8 bytes cuts the same
characters.  The cut is marked with byte 0xFF, which no UTF-8 text holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text per slice of a batch; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
_UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
_END = b"\xff"


def units(texts: pa.Array) -> pa.ListArray:
    """Units of every text (binary); an empty text has none."""
    marked = pc.replace_substring_regex(texts, pattern=_UNIT, replacement=rb"\1" + _END)
    split = pc.split_pattern(marked, pattern=_END)  # one empty piece behind the last mark
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, parents = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int64)
    ordinal = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[parents]
    kept = flat.filter(pa.array(ordinal < sizes[parents] - 1))
    return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes - 1))), kept)


def _joined(flat: pa.Array, parents: np.ndarray, role: np.ndarray, rows: int) -> pa.Array:
    """Units of one role, joined by row."""
    counts = np.bincount(parents[role], minlength=rows)
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts))), flat.filter(pa.array(role)))
    return pc.binary_join(lists, pa.scalar(b"", flat.type))


def _characters(pieces: pa.Array) -> pa.Array:
    return pc.utf8_length(pieces.cast(pa.large_utf8())).cast(pa.int64())


_SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group, start, held = 0, 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, first and second (places that n + 1 divides), wanted (form by draw)."""
    for batch in (part for whole in batches for part in _slices(whole)):
        text = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
        lists = units(text)
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ordinal = np.arange(len(flat)) - (np.cumsum(n) - n)[parents]

        marked = pc.or_(pc.or_(*[pc.match_substring(text, m.encode()) for m in (PREFIX, SUFFIX)]), pc.match_substring(text, MIDDLE.encode()))
        plain = pc.or_(pc.equal(pc.binary_length(text), 0), marked)
        form = pc.if_else(plain, "plain", batch.column("wanted"))

        draws = [batch.column(c).to_numpy(zero_copy_only=False) % (n + 1) for c in ("first", "second")]
        begin, end = np.minimum(*draws), np.maximum(*draws)
        roles = (ordinal < begin[parents], (ordinal >= begin[parents]) & (ordinal < end[parents]), ordinal >= end[parents])
        before, middle, after = (_joined(flat, parents, role, len(n)) for role in roles)

        p, s, m = (pa.scalar(x.encode(), pa.large_binary()) for x in (PREFIX, SUFFIX, MIDDLE))
        none = pa.scalar(b"", pa.large_binary())
        psm = pc.binary_join_element_wise(p, before, s, after, m, middle, none)
        spm = pc.binary_join_element_wise(s, after, p, before, m, middle, none)
        is_plain, is_psm = pc.equal(form, "plain"), pc.equal(form, "psm")
        output = pc.if_else(is_plain, text, pc.if_else(is_psm, psm, spm)).cast(pa.large_utf8()).cast(pa.utf8())
        lengths = [pc.if_else(is_plain, pa.scalar(None, pa.int64()), _characters(x)) for x in (before, middle)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), form, *lengths, output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def draw(doc_id: Column, seed: int, group: int) -> Column:
    """The group-th (from 0) 32-bit number of sha256 of ``seed:doc_id``; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_share: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row.

    Units are a word with the white space before it, or trailing white space.  ``rate``
    percent of the texts are transformed, of these ``spm_share`` percent suffix first.
    Null counts as empty; empty texts and texts that hold a marker stay as they are (form
    plain, null lengths).  Draws depend on the seed and the id alone, so rows that repeat
    an id are cut alike; a null id draws as empty text.  An empty table gives an empty
    table; other columns are ignored.  Narrow: no shuffle, and a slice of a batch holds
    one text or a few megabytes.
    """
    doc_id = F.col(id_col).cast("long")
    wanted = F.when(draw(doc_id, seed, 2) % 100 >= rate, "plain").when(draw(doc_id, seed, 3) % 100 < spm_share, "spm").otherwise("psm")
    rows = docs.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"), draw(doc_id, seed, 0).alias("first"), draw(doc_id, seed, 1).alias("second"), wanted.alias("wanted"))
    return rows.mapInArrow(_transform, _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: markers occur in no transformed text, so they part it."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda i: F.get(part, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digests = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return materialize(digests, "fim-digests")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), e AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), f AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM e
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""
