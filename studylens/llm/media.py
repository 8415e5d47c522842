"""Media columns: interleaved document sequences with digest-resolved payloads.

A page becomes an ordered list of items: text blocks and media references with their
captions, each with its position.  Media live once in a store keyed by digest; a
reference resolves by joining on the digest, and positions and captions stay with the
reference, so order and alignment survive any shuffle.

``interleave`` reads any HTML.  ``text_media`` keeps a document's text as media: its page
holds two figures, the whole text as an image and its last row as a strip of its own.
What the result says of a document is read from its resolved sequence by position, and
each item's caption must agree with what its digest resolved to.
"""

from __future__ import annotations

import hashlib
import html
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, materialize, texts

#: Samples per row of the stored images; payloads are padded to whole rows.
ROW = 64
ITEMS = "array<struct<position:int,kind:string,text:string,media_ref:string,caption:string>>"
_SILENT = {"script", "style", "noscript", "template", "svg", "head"}
_BLOCKS = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th", "pre", "blockquote", "figure", "figcaption", "br", "hr", "header", "footer", "nav", "main", "aside", "body", "html"}
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source"}
_VOID = {"img", "br", "hr", "source", "meta", "link", "input", "area", "base", "col", "embed", "track", "wbr"}


class _Interleaver(HTMLParser):
    """Text blocks and media references in document order; broken markup never raises."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.buffer: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text:
            self._add("text", text, None, None)

    def _add(self, kind: str, text: str | None, ref: str | None, caption: str | None) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "media_ref": ref, "caption": caption})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
            return
        if tag in _BLOCKS:
            self._flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA:
            values = dict(attrs)
            ref = values.get("data-digest") or values.get("src")
            if ref:
                self._flush()
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self._add(_MEDIA[tag], None, ref, values.get("alt") or None)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
            return
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for i in self.figure or []:
                self.items[i]["caption"] = text or self.items[i]["caption"]
            if not self.figure and text:
                self._add("text", text, None, None)
            self.caption = None
        elif tag == "figure":
            self._flush()
            self.figure = None
        elif tag in _BLOCKS:
            self._flush()

    def handle_data(self, data):
        if not self.silent:
            (self.buffer if self.caption is None else self.caption).append(data)

    def result(self, page: str) -> list[dict]:
        self.feed(page)
        self.close()
        if self.caption is not None:
            self.handle_endtag("figcaption")
        self._flush()
        return self.items


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of ``keep``, items: text blocks and media references in order.

    Null and empty pages have an empty list; a figure's caption goes to the media in it;
    markup without end is read to its end.  Repeated rows stay, an empty table gives an
    empty table, other columns are ignored.  Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media_ref", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            items = [_Interleaver().result(page or "") for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(items, kind)], names=["id", *keep, "items"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"), *keep)
    kept = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"id bigint{kept}, items {ITEMS}")


def references(sequences: DataFrame) -> DataFrame:
    """The columns beside ``items`` with position, media_ref and caption of every media item."""
    others = [c for c in sequences.columns if c != "items"]
    item = F.explode(F.filter("items", lambda x: x["media_ref"].isNotNull())).alias("item")
    return sequences.select(*others, item).select(*others, "item.position", "item.media_ref", "item.caption")


def resolve(refs: DataFrame, store: DataFrame) -> DataFrame:
    """References with the columns of ``store`` (one row per media_ref); unknown ones get nulls.

    ``store`` should be a written table: both sides are then plain exchanges and a digest
    that many documents share is split by adaptive execution.
    """
    return refs.join(store, "media_ref", "left")


def encode_media(payload: bytes) -> bytes:
    """Binary greymap (PGM) of 8-bit samples, ROW to a line; ``payload`` is whole rows."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def decode_media(media: bytes) -> bytes:
    kind, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a whole 8-bit greymap")
    return samples


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of ROW."""
    return data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b"\0")


def _feature(samples: bytes) -> str:
    x = np.frombuffer(samples, dtype=np.uint8)
    levels = np.bincount(x >> 5, minlength=8) / len(x)
    edges = np.abs(np.diff(x.astype(np.int16))).mean() if len(x) > 1 else 0.0
    return f"{ROW}x{len(x) // ROW};mean={x.mean():.3f};sd={x.std():.3f};edge={edges:.3f};levels=" + "/".join(f"{v:.3f}" for v in levels)


_PAGES = "page string, doc_id bigint, html string, media array<struct<media_ref:string,media:binary>>"
_STORED = "media_ref string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
_MEDIA_LIST = pa.list_(pa.struct([("media_ref", pa.string()), ("media", pa.binary())]))
#: Bytes of text that become pages at a time.
PAGE_BYTES = 4 << 20


def _figure(ref: str, caption: str) -> str:
    return f'<figure><img data-digest="{ref}"><figcaption>{html.escape(caption)}</figcaption></figure>'


def _to_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text as a page with two figures, and the media that the page refers to by digest."""
    names = ["page", "doc_id", "html", "media"]
    for batch in batches:
        lead, rows, taken, held = uuid.uuid4().hex, [], 0, 0
        for doc_id, data in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            payload = padded(data)
            media = []
            for part in (payload, payload[-ROW:]):
                image = encode_media(part)
                media.append({"media_ref": "sha256:" + hashlib.sha256(image).hexdigest(), "media": image})
            body = f"<p>Text as 8-bit samples</p>{_figure(media[0]['media_ref'], f'{len(data)} bytes of text')}<p>Its last row</p>{_figure(media[1]['media_ref'], f'{ROW} bytes of {len(payload)}')}"
            if len(payload) == ROW:  # one row is both, and is stored once
                media.pop()
            rows.append((f"{lead}-{taken}-{len(rows)}", doc_id, f"<article>{body}</article>", media))
            held += len(payload)
            if held > PAGE_BYTES:
                yield _page_batch(rows, names)
                rows, taken, held = [], taken + 1, 0
        if rows:
            yield _page_batch(rows, names)


def _page_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), _MEDIA_LIST]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the stored bytes say, by digest; bytes that do not match their digest fail the job."""
    for batch in batches:
        rows = []
        for ref, media in zip(batch.column(0).to_pylist(), batch.column(1)):
            media = media.as_py()
            digest = hashlib.sha256(media).hexdigest()
            if ref != "sha256:" + digest:
                raise ValueError(f"stored media differ from {ref}")
            samples = decode_media(media)
            rows.append((ref, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(media), digest, _feature(samples)))
        columns = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["media_ref", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def sequences_of(resolved: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys`` and ``sequence``: the resolved items of a page, put back in the order of their positions."""
    item = F.struct("position", "caption", *columns)
    return resolved.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("sequence"))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its text as stored media, resolved through its page.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, positions, captions.  Null and empty texts are one row of zero
    samples; equal texts give equal values; repeated rows and rows without id stay; an
    empty table gives an empty table; other columns are ignored.

    The media table is written to the shared folder and read back; payloads never
    shuffle.  Features are computed where the media are read, reduced to one row per
    digest, and meet the references by digest.  A page has two references, so a sequence
    is a short list; the first item is the text and the second its last row.  A caption
    that does not agree with its resolved item fails the job.
    """
    pages = materialize(documents(docs, id_col, text_col).mapInArrow(_to_pages, _PAGES), "media-pages")
    read = pages.select(F.explode("media").alias("m")).select("m.media_ref", "m.media").mapInArrow(_read_back, _STORED)
    columns = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    store = materialize(read.groupBy("media_ref").agg(*[F.min(c).alias(c) for c in columns]), "media-store")
    refs = references(interleave(pages, "doc_id", "html", keep=("page",)))
    rows = sequences_of(resolve(refs, store), ["page", "id"], columns)
    whole, tail = F.get("sequence", F.lit(0)), F.get("sequence", F.lit(1))
    n_bytes = F.regexp_extract(whole["caption"], r"^(\d+) bytes of text$", 1).try_cast("long")
    fits = (F.greatest(F.lit(ROW), F.ceil(n_bytes / ROW) * ROW) == whole["payload_bytes"]) & (tail["caption"] == F.concat(F.lit(f"{ROW} bytes of "), whole["payload_bytes"].cast("string"))) & (tail["payload_bytes"] == ROW)
    checked = F.when(fits, n_bytes).otherwise(F.raise_error(F.lit("captions and media do not align")).cast("long"))
    return rows.select(
        F.col("id").alias("doc_id"), checked.alias("n_bytes"), whole["payload_bytes"].alias("payload_bytes"), whole["payload_sha256"].alias("payload_sha256"), tail["tail_crc32"].alias("tail_crc32"),
        whole["media_bytes"].alias("media_bytes"), whole["media_sha256"].alias("media_sha256"), whole["feature"].alias("feature"),
        F.transform("sequence", lambda x: x["position"]).alias("positions"), F.transform("sequence", lambda x: x["caption"]).alias("captions"),
    )


def page_sequences(pages: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, items, text_items, media_items, resolved_items, text_sha256, outline.

    ``outline`` lists position, kind and caption of the media in order; ``text_sha256`` is
    over the text blocks joined by newlines.  ``store`` (media_ref first) resolves media;
    without one none resolves.  Null and empty pages have no items; repeated rows stay.
    """
    rows = interleave(pages.withColumn("_row", F.monotonically_increasing_id()), keep=("_row",))
    rows = materialize(rows, "page-items")
    refs = references(rows)
    if store is None:
        store = refs.select("media_ref").limit(0)
    found = resolve(refs, store.select("media_ref").distinct().withColumn("known", F.lit(1)))
    media = found.groupBy("_row").agg(F.count("*").alias("media_items"), F.count("known").alias("resolved_items"))
    texts_ = F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"])
    outline = F.array_join(F.transform(F.filter("items", lambda x: x["kind"] != "text"), lambda x: F.concat_ws(":", x["position"].cast("string"), x["kind"], x["caption"])), "|")
    out = rows.join(media, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias("page_id"), F.size("items").cast("long").alias("items"), F.size(texts_).cast("long").alias("text_items"), zero("media_items"), zero("resolved_items"), F.sha2(F.array_join(texts_, "\n"), 256).alias("text_sha256"), outline.alias("outline"))


def media_page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_sequences(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
