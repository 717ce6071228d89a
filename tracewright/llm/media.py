"""Media columns: interleaved document sequences.

HTML is parsed into an ordered array of text and media-reference structs. Media payloads live in a table of their own
under the digest of their content; references join them by digest, so a sequence keeps its order and each caption stays
with its reference, whatever the payloads weigh. Payloads are stored losslessly as 8-bit grey PNG samples, 192 a row.

Defined cases: null or empty HTML is an empty sequence; a reference without a digest or without a stored payload keeps
its place with null media columns; equal payloads are stored under one digest; repeated rows stay repeated; other columns
are carried or ignored as named.
"""

from __future__ import annotations

import hashlib
import html as markup
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, salted_left_join, slices, stored

ROW = 192
PREFIX = "sha256:"
SKIPPED = {"script", "style", "nav", "footer", "template", "noscript"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div", "article", "section", "blockquote", "pre", "td", "figcaption", "figure", "title", "br"}
ITEM = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
ITEM_TYPE = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


class _Sequence(HTMLParser):
    """Collects text blocks and media references in document order; a figcaption belongs to its figure's references."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skip: list[str] = []
        self.figure: list[dict] | None = None
        self.caption = False

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if not text:
            return
        if self.caption:
            for x in self.figure or ():
                x["caption"] = text
        else:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.flush()
            self.skip.append(tag)
        if self.skip:
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = True
        elif tag in ("img", "video", "audio"):
            self.flush()
            a = dict(attrs)
            src = a.get("src") or ""
            item = {"kind": "media", "text": None, "digest": src[len(PREFIX) :] if src.startswith(PREFIX) else None, "caption": a.get("alt")}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "figcaption":
            self.caption = False
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def sequence_of(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"position": i, **x} for i, x in enumerate(parser.items)]


def parsed(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, sequence): the ordered items of each page."""

    def run(batches):
        for b in batches:
            raw = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sequence_of(x) for x in raw], ITEM_TYPE)], [key, "sequence"])

    return pages.select(key, html).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, sequence {ITEM}")


def png_of(payload: bytes) -> bytes:
    """payload (a multiple of ROW) as an 8-bit grey PNG, one unfiltered row for each ROW bytes."""
    rows = len(payload) // ROW
    grid = np.zeros((rows, ROW + 1), np.uint8)
    grid[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(grid.tobytes(), 1)) + chunk(b"IEND", b"")


def samples_of(png: bytes) -> bytes:
    """The samples of a PNG that png_of wrote; each chunk's checksum is verified."""
    at, data, width, rows = 8, b"", 0, 0
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a stored PNG is damaged")
        if kind == b"IHDR":
            width, rows = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(rows, width + 1)[:, 1:].tobytes()


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW, b" ")


def feature_of(payload: bytes) -> str:
    """Sum, distinct values and a 64-bit average hash of the samples in 64 near-equal runs."""
    x = np.frombuffer(payload, np.uint8)
    total = int(x.sum(dtype=np.int64))
    at = np.arange(64) * len(x) // 64
    sums = np.add.reduceat(x.astype(np.int64), at)
    bits = sums * len(x) > total * np.diff(np.append(at, len(x)))
    return f"sum={total};distinct={len(np.flatnonzero(np.bincount(x, minlength=256)))};ahash={np.packbits(bits).tobytes().hex()}"


def text_page(text: str, digest: str) -> str:
    """A page of the text's lines as paragraphs, with the text's own payload referenced half way down: half of the lines, the
    figure and its caption (the number of bytes), then the other half."""
    lines = [f"<p>{markup.escape(x)}</p>" for x in text.split("\n") if x.split()]
    figure = f'<figure><img src="{PREFIX}{digest}"><figcaption>{len(text.encode())}</figcaption></figure>'
    half = len(lines) // 2
    return "".join(["<article>", *lines[:half], figure, *lines[half:], "</article>"])


def payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, media): each text as media; media is null where the task has stored that digest already."""

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column(1))
            seen: set = set()
            for i, j in slices(texts):
                found, media = [], []
                for t in texts[i:j]:
                    payload = padded(t)
                    digest = hashlib.sha256(payload).hexdigest()
                    found.append(digest)
                    media.append(None if digest in seen else png_of(payload))
                    seen.add(digest)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(found, pa.string()), pa.array(media, pa.binary())], ["doc_id", "digest", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, digest string, media binary")


def text_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, html): each text as an interleaved page."""

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column(1))
            for i, j in slices(texts):
                pages = [text_page(t.decode("utf-8", "replace"), hashlib.sha256(padded(t)).hexdigest()) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(pages, pa.string())], ["doc_id", "html"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, html string")


def media_features(store: DataFrame) -> DataFrame:
    """Features of stored media(digest, media), computed from the bytes read back; one row for each digest."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for png in b.column(1).to_pylist():
                back = samples_of(png)
                values = (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(png), hashlib.sha256(png).hexdigest(), feature_of(back))
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], names)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store.where("media IS NOT NULL").select("digest", "media").mapInArrow(run, schema).dropDuplicates(["digest"])


def resolved(sequences: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """One row for each item of each sequence, in columns key, position, kind, text, digest, caption and the media's."""
    items = sequences.select(key, F.explode("sequence").alias("x")).select(key, "x.*")
    return salted_left_join(items, features, "digest")


def media_report(docs: DataFrame) -> DataFrame:
    """Every text stored as media, referenced from the interleaved page of its own lines, read back and joined to the reference.

    Payloads are written once and never shuffled: their features (a short row a digest) are what the join moves. Pages are
    parsed as they are made; of their items only the references travel. position: the reference's place in its sequence of
    n_items; before: the text block that precedes it.
    """
    store = stored(payloads(docs), "media")
    seen = parsed(text_pages(docs), "doc_id")
    at = F.col("x.position")
    refs = seen.select("doc_id", F.size("sequence").alias("n_items"), "sequence", F.explode(F.filter("sequence", lambda x: x["kind"] == "media")).alias("x"))
    refs = refs.select("doc_id", "x.*", "n_items", F.when(at > 0, F.get("sequence", at - 1)["text"]).alias("before"))
    items = salted_left_join(refs, media_features(store), "digest")
    return items.select(
        "doc_id", F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "n_items", "before",
    )
