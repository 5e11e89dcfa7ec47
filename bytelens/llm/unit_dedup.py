"""Substring dedup by hashing units: lines, and sentences of `SENTENCE_WORDS` words or more.

A unit is normalised (lower case, white space collapsed, no outer punctuation) and hashed; digests
are grouped over the corpus; the occurrence that ranks first, by doc_id and then position, stays and
all later ones go.  A line goes as a whole if an earlier equal line exists; the sentences of other
lines go one by one.  What is removed is reported with its byte offsets in the original text.

Null texts have no unit; units without a letter or digit are left alone; null doc_ids rank last;
rows of equal doc_id rank by the hash of their text; of rows that are equal in both, one keeps what
is first in it and the others lose all their units; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import flag_twins, prepare, sweep, table
from .textops import ALNUM, BASE, column, mix, part, slices, utf8, words

SENTENCE_WORDS = 8
SEED = 3


def unit_rows(data: np.ndarray, offsets: np.ndarray, least: int):
    """First bytes, end bytes, digests and rows of the lines with a word, then of the sentences.

    The digest is of the unit's words (runs of letters, digits and non-ASCII), lower case.
    """
    h, starts, ends, bounds = words(data, offsets, ALNUM, SEED)
    if not len(h):
        return
    stops = np.flatnonzero((data == 46) | (data == 33) | (data == 63))
    stops = stops[(stops + 1 >= len(data)) | np.isin(data[np.minimum(stops + 1, len(data) - 1)], (9, 10, 13, 32, 34, 39, 41))]
    breaks = np.flatnonzero(data == 10)
    cuts_line = np.unique(np.concatenate([offsets, breaks + 1]))
    cuts_all = np.unique(np.concatenate([cuts_line, stops + 1]))
    for cuts, is_line in ((cuts_line, True), (cuts_all, False)):
        lo, hi = cuts[:-1], cuts[1:]
        a, b = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
        keep = b - a >= (1 if is_line else least)
        lo, hi, a, b = lo[keep], hi[keep], a[keep], b[keep]
        yield lo, hi, digests(h, a, b), np.searchsorted(offsets, lo, side="right") - 1


def digests(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word sequence h[a:b], wherever it stands: sums of scrambled (word, place)."""
    n = b - a
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    h = h[np.repeat(a, n) + place]
    place = mix(place.astype(np.uint64) * np.uint64(BASE) + np.uint64(1))
    one, two = mix(h ^ place), mix(h + place)
    size = mix(n.astype(np.uint64))
    return tuple(mix(np.add.reduceat(x, first) + size) if len(n) else size for x in (one, two))


def units(least: int):
    """Unit rows (d1, d2, rank, tk, lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = column(batch, "rank").to_numpy(), column(batch, "tk").to_numpy()
            data, offsets = utf8(column(batch, "text"))
            for i, j in slices(offsets):
                d, o = part(data, offsets, i, j)
                for lo, hi, (d1, d2), row in unit_rows(d, o, least):
                    base = o[row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(ids[i:j][row]), pa.array(keys[i:j][row]), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))],
                        names=["d1", "d2", "rank", "tk", "lo", "hi"],
                    )

    return run


def later_units(docs: DataFrame, least: int = SENTENCE_WORDS) -> DataFrame:
    """(rank, tk, spans): the units of each document that an earlier equal unit makes superfluous."""
    spark = docs.sparkSession
    found = table(docs.select("rank", "tk", "text").mapInArrow(units(least), "d1 long, d2 long, rank long, tk long, lo int, hi int"))
    key = ["d1", "d2"]
    first = found.groupBy(key).agg(F.count("*").alias("n"), F.min("rank").alias("first")).filter("n > 1").select(*key, "first")
    hits = table(found.join(first, key))
    sweep(spark)
    home = hits.filter("rank = first").groupBy(key).agg(F.min(F.struct("tk", "lo")).alias("at"))
    here = hits.filter("rank = first").join(home, key).filter("tk != at.tk or lo != at.lo").select("rank", "tk", "lo", "hi")
    gone = hits.filter("rank != first").select("rank", "tk", "lo", "hi").unionByName(here)
    return gone.groupBy("rank", "tk").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def cut(least: int):
    """Remove the spans, or all units of a twin; report them merged, in bytes of the original text."""
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, removed, merged = [], [], [], []
            for text, spans, twin in zip(*(column(batch, c).to_pylist() for c in ("text", "spans", "_twin")), strict=True):
                raw = (text or "").encode()
                ranges = [(s["lo"], s["hi"]) for s in spans or ()]
                if twin:
                    data = np.frombuffer(raw, np.uint8)
                    ranges = [x for lo, hi, _, _ in unit_rows(data, np.array([0, len(raw)]), least) for x in zip(lo.tolist(), hi.tolist(), strict=True)]
                runs: list[list[int]] = []
                for lo, hi in sorted(ranges):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                pieces, at = [], 0
                for lo, hi in runs:
                    pieces.append(raw[at:lo])
                    at = hi
                texts.append(None if text is None else b"".join([*pieces, raw[at:]]).decode())
                sizes.append(len(raw))
                removed.append(sum(hi - lo for lo, hi in runs))
                merged.append([{"lo": lo, "hi": hi} for lo, hi in runs])
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(merged, kind), pa.array(texts, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "removed", "text"],
            )

    return run


def remove_later(docs: DataFrame, least: int = SENTENCE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (byte ranges of the original), text (what is left)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumns({"rank": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "tk": F.xxhash64(F.coalesce("text", F.lit("")))})
    rows = flag_twins(docs, "rank", "tk").join(later_units(docs, least), ["rank", "tk"], "left").select("doc_id", "text", "spans", "_twin")
    return rows.mapInArrow(cut(least), "doc_id long, n_bytes long, n_removed long, removed array<struct<lo:int,hi:int>>, text string")
