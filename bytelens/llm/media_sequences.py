"""Media columns: interleaved document sequences.

A page is parsed into an ordered sequence of text and media references; references are resolved by
a digest join with a media store, and come back to their place with their caption.  Payloads are
stored losslessly as 8-bit grey samples (binary PGM) and read back for their features, so that only
digests and features, never payloads, go through the join.

Null or empty html, and pages without text and media, have an empty sequence; a null payload is empty; unknown digests stay unresolved (null
media columns); equal payloads are one media; repeated pages and clashing column names are kept
apart (only the named columns are read); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import prepare, table
from .textops import column

WIDTH = 192
PAD = b" "
TAIL = 16
SCHEME = "media:"
SEGMENT = "struct<pos:int,kind:string,text:string,ref:string,caption:string>"


class Sequence(HTMLParser):
    """Text and media references of a page in their order; captions go with the media of their figure.

    A caption belongs to all media of its figure, wherever it stands in it, and ends with the figure
    at the latest; one that neither end closes is text.  What is in a template or noscript element is
    left out if the element is closed.
    """

    MEDIA = ("img", "video", "audio", "source", "embed", "object")
    SILENT = ("script", "style")
    HIDDEN = ("template", "noscript")
    BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr title ul".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.held: list[str] = []
        self.silent = 0
        self.hidden: list[tuple[str, int]] = []  # open elements and the segments before them
        self.figures: list[dict] = []  # open figures: the segments before them, and their captions so far
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.out.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def end_caption(self) -> None:
        if self.caption is None:
            return
        text = " ".join("".join(self.caption).split())
        self.caption = None
        if self.figures:
            self.figures[-1]["captions"].append(text)
        elif text:
            self.out.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def end_figure(self) -> None:
        self.end_caption()
        self.flush()
        figure = self.figures.pop()
        text = " ".join(c for c in figure["captions"] if c)
        for segment in self.out[figure["first"] :]:
            if segment["kind"] == "media" and text and not segment.get("done"):
                segment |= {"caption": text, "done": True}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SILENT:
            self.silent += 1
        if tag in self.BLOCKS and self.caption is None:
            self.flush()
        if tag in self.HIDDEN:
            self.flush()
            self.hidden.append((tag, len(self.out)))
        elif tag == "figure":
            self.end_caption()
            self.figures.append({"first": len(self.out), "captions": []})
        elif tag == "figcaption":
            self.end_caption()
            self.caption = []
        elif tag in self.MEDIA:
            have = dict(attrs)
            ref = have.get("src") or have.get("data-src") or have.get("data") or ((have.get("srcset") or "").replace(",", " ").split() or [None])[0]
            if ref:
                self.flush()
                self.out.append({"kind": "media", "text": None, "ref": ref, "caption": have.get("alt") or have.get("title")})

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()
        elif tag in self.HIDDEN and any(t == tag for t, _ in self.hidden):
            self.flush()
            while (last := self.hidden.pop())[0] != tag:
                pass
            del self.out[last[1] :]
        elif tag in self.BLOCKS and self.caption is None:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.held if self.caption is None else self.caption).append(data)

    def finish(self) -> list[dict]:
        """All segments; what is still open ends here."""
        self.close()
        self.flush()
        if self.caption is not None:  # never closed: it is the rest of the page
            self.held, self.caption = self.caption, None
            self.flush()
        while self.figures:
            self.end_figure()
        return [{k: x[k] for k in ("kind", "text", "ref", "caption")} for x in self.out]


def parse(html: str | None) -> list[dict]:
    """The segments of a page: pos, kind (text or media), text, ref, caption."""
    page = Sequence()
    page.feed(html or "")
    return [{"pos": i, **segment} for i, segment in enumerate(page.finish())]


def parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
    for batch in batches:
        rows = [parse(x) for x in column(batch, "html").to_pylist()]
        yield pa.RecordBatch.from_arrays([column(batch, "page_key"), column(batch, "page_id"), pa.array(rows, kind)], names=["page_key", "page_id", "segments"])


def padded(raw: bytes) -> bytes:
    return raw + PAD * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def encode(payload: bytes) -> bytes:
    """Samples of 8 bits, `WIDTH` a row, as binary PGM."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def decode(stored: bytes) -> bytes:
    """The samples of a PGM that `encode` has written."""
    kind, shape, depth, samples = stored.split(b"\n", 3)
    width, height = map(int, shape.split())
    if kind != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit grey image")
    return samples


def store_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payload texts to stored media: owner, n_bytes, digest of the padded payload, stored bytes."""
    for batch in batches:
        sizes, digests, stored = [], [], []
        for text in column(batch, "payload").to_pylist():
            raw = b"" if text is None else text.encode()
            payload = padded(raw)
            sizes.append(len(raw))
            digests.append(hashlib.sha256(payload).hexdigest())
            stored.append(encode(payload))
        yield pa.RecordBatch.from_arrays([column(batch, "owner"), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(stored, pa.binary())], names=["owner", "n_bytes", "digest", "media"])


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(samples: bytes) -> str:
    """Rows, mean, standard deviation and entropy of the samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256).astype(np.float64)
    p = counts / max(1.0, counts.sum())
    level = np.arange(256)
    mean = float(p @ level)
    spread = float(np.sqrt(max(0.0, p @ (level - mean) ** 2)))
    bits = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    return f"rows={len(samples) // WIDTH} mean={mean:.4f} std={spread:.4f} entropy={bits:.4f}"


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for digest, stored in zip(column(batch, "digest").to_pylist(), column(batch, "media").to_pylist(), strict=True):
            samples = decode(stored)
            out.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names=names)


def store(payloads: DataFrame) -> DataFrame:
    """The media store of `payloads` (owner, payload): written to the shared folder."""
    prepare(payloads.sparkSession)
    return table(payloads.select(F.col("owner").cast("long").alias("owner"), F.col("payload").cast("string").alias("payload")).mapInArrow(store_rows, "owner long, n_bytes long, digest string, media binary"))


def media_features(stored: DataFrame) -> DataFrame:
    """One row per digest: what is read back from the stored bytes."""
    return stored.select("digest", "media").mapInArrow(read_back, FEATURES).dropDuplicates(["digest"])


def interleave(pages: DataFrame, media: DataFrame) -> DataFrame:
    """page_key, page_id and the page's ordered segments, media resolved by digest.

    `pages` has page_id and html; references look like `media:<digest>`.  The result's segments are
    structs of pos, kind, text, ref, caption and media (the row of `media`, null if unknown).
    """
    prepare(pages.sparkSession)
    keyed = pages.select(F.monotonically_increasing_id().alias("page_key"), F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    parsed = table(keyed.mapInArrow(parse_pages, f"page_key long, page_id long, segments array<{SEGMENT}>"))
    flat = parsed.select("page_key", "page_id", F.explode_outer("segments").alias("s")).select("page_key", "page_id", "s.*")
    rows = media.select("digest", F.struct(*media.columns).alias("media"))
    empty = F.lit(None).cast(rows.schema["media"].dataType).alias("media")
    refers = F.coalesce((F.col("kind") == "media") & F.col("ref").startswith(SCHEME), F.lit(False))
    linked = flat.filter(refers).withColumn("digest", F.substring("ref", len(SCHEME) + 1, 1 << 20)).join(rows, "digest", "left").drop("digest")
    plain = flat.filter(~refers).withColumn("media", empty)  # kept out of the join, where they would all meet under one null key
    segment = F.when(F.col("pos").isNotNull(), F.struct("pos", "kind", "text", "ref", "caption", "media"))  # null, and not collected, for a page without any
    return linked.unionByName(plain).groupBy("page_key", "page_id").agg(F.sort_array(F.collect_list(segment)).alias("segments"))


def page_sequences(pages: DataFrame) -> DataFrame:
    """page_id, number of segments and of media, and the text of every page of `pages`; nothing is resolved."""
    none = pages.sparkSession.createDataFrame([], FEATURES)
    rows = interleave(pages, none)
    media = F.filter("segments", lambda s: s["kind"] == "media")
    text = F.array_join(F.transform(F.filter("segments", lambda s: s["kind"] == "text"), lambda s: s["text"]), "\n")
    return rows.select("page_id", F.size("segments").cast("long").alias("n_segments"), F.size(media).cast("long").alias("n_media"), text.alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Each document as a page with its text as media: the resolved media of its sequence."""
    stored = store(docs.select(F.col("doc_id").alias("owner"), F.col("text").alias("payload")))
    html = F.concat(F.lit("<article><p>document</p><figure><img src='" + SCHEME), F.col("digest"), F.lit("'><figcaption>"), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    pages = stored.select(F.col("owner").alias("page_id"), html.alias("html"))
    sequences = interleave(pages, media_features(stored))
    found = sequences.select("page_id", F.filter("segments", lambda s: s["kind"] == "media")[0].alias("s"))
    m = F.col("s.media")
    return found.select(
        F.col("page_id").alias("doc_id"), F.regexp_extract("s.caption", "^([0-9]+)", 1).cast("long").alias("n_bytes"),
        *(m[c].alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")),
    )
