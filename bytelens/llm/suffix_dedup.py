"""Suffix-array dedup: remove every byte of a string of `LENGTH` bytes that occurs elsewhere too.

The corpus is not one array that a task could sort.  Every window of `LENGTH` bytes has an anchor:
the leftmost least hash among its `GRAM`-byte grams.  Equal windows have equal anchors at equal
offsets, so all suffixes that can share `LENGTH` bytes meet under one anchor hash, and the sparse
suffix array of an anchor (its occurrences sorted by what follows) holds every repeat through it.

An occurrence whose whole surroundings occur twice is decided by counting.  The rest goes to the
kernel: the enhanced suffix array of the anchor is scanned with a stack for its common-prefix
intervals, and in each interval the left extensions are compared; where they differ the interval
is a maximal repeat, reported with all occurrences.  A group of more than `MOST` different
surroundings isn't sorted by one task: its windows are counted one by one in the shuffle.

Null texts are empty; texts shorter than `LENGTH` have no window; documents with equal texts are
found by their text, so repeated rows and null doc_ids need no care; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bitmap, discard, prepare, seen, sweep, table
from .textops import column, mix, part, powers, prefix_sums, slices, span_sums, utf8

LENGTH = 200
GRAM = 100
MOST = 512


def anchors(sums: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows, and their gram hashes."""
    n = len(sums) - 1
    grams, w = n - gram + 1, length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = mix((sums[gram - 7 : n - 6] - sums[:grams]) * powers(n)[1][:grams])  # of 8 bytes from each position on
    bits = np.uint64(32)  # the order is by the upper half of the hash, then by position
    key = ((h >> bits) << bits) | np.arange(grams, dtype=np.uint64)
    padded = -(-grams // w) * w
    block = np.full(padded, np.uint64(0xFFFFFFFFFFFFFFFF))
    block[:grams] = key
    block = block.reshape(-1, w)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(right[:starts], left[w - 1 : w - 1 + starts])
    del block, left, right, key
    room = np.zeros(starts + 1, np.int32)  # windows that cross documents are none
    for end in offsets[1:-1].tolist():
        a, b = max(0, end - length + 1), min(end, starts)
        if a < b:
            room[a] += 1
            room[b] -= 1
    crossing = np.cumsum(room[:-1]) > 0
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)[~crossing]
    if not len(at):
        return at, np.zeros(0, np.uint64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, h[at]


def located(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, length: int, gram: int):
    """The anchors of some texts: hash, hash of the surroundings, text key, position, surroundings' ends."""
    sums = prefix_sums(data)
    at, h = anchors(sums, offsets, length, gram)
    row = np.searchsorted(offsets, at, side="right") - 1
    side = length - gram
    lo = np.maximum(at - side, offsets[row])
    hi = np.minimum(at + length, offsets[row + 1])
    shape = (at - lo).astype(np.uint64) * np.uint64(65537) + (hi - at).astype(np.uint64)
    around = mix(span_sums(sums, lo, hi) + mix(shape))
    return h.view(np.int64), around.view(np.int64), keys[row], at - offsets[row], lo, hi, row


def scan(length: int, gram: int):
    """Anchor rows (h, c, tk, pos), one per text key, position and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = column(batch, "tk").to_numpy()
            data, offsets = utf8(column(batch, "text"))
            for i, j in slices(offsets):
                h, c, tk, pos, *_ = located(*part(data, offsets, i, j), keys[i:j], length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(tk), pa.array(pos.astype(np.int32))], names=["h", "c", "tk", "pos"])

    return run


def spot(tk: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The bitmap key of a position in a text (see `spot_column`)."""
    return tk ^ (pos.astype(np.int64) << np.int64(5))


def spot_column():
    return F.col("tk").bitwiseXOR(F.shiftleft(F.col("pos").cast("long"), 5))


def surroundings(length: int, gram: int, words: np.ndarray):
    """The bytes left (reversed) and right of the anchors whose position may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # of copies one is enough
        for batch in batches:
            keys = column(batch, "tk").to_numpy()
            fresh = [i for i, k in enumerate(keys.tolist()) if k not in done]
            done.update(keys.tolist())
            if len(done) > 1_000_000:
                done.clear()
            batch = batch.take(pa.array(fresh, pa.int32()))
            keys = column(batch, "tk").to_numpy()
            data, offsets = utf8(column(batch, "text"))
            for i, j in slices(offsets):
                d, o = part(data, offsets, i, j)
                h, c, tk, pos, lo, hi, row = located(d, o, keys[i:j], length, gram)
                keep = np.flatnonzero(seen(words, spot(tk, pos)))
                if not len(keep):
                    continue
                raw = d.tobytes()
                at = pos[keep] + o[row[keep]]
                left = [raw[a:b][::-1] for a, b in zip(lo[keep].tolist(), at.tolist(), strict=True)]
                right = [raw[a:b] for a, b in zip((at + gram).tolist(), hi[keep].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[keep]), pa.array(tk[keep]), pa.array(pos[keep].astype(np.int32)), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                    names=["h", "tk", "pos", "left", "right"],
                )

    return run


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (depth, first, last) of a suffix array, children before parents.

    `lcp[i]` is the common prefix of suffixes i and i + 1.
    """
    stack: list[list[int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append([depth, first])


def maximal_repeats(left: list[bytes], right: list[bytes], middle: int, least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes left of the anchor, bytes from it on, occurrences) of every maximal repeat of `least` bytes.

    `left` is reversed.  The occurrences of an interval share `depth` bytes to the right and no
    more; among them those that share some bytes to the left, and no more, form a repeat that can
    be extended on neither side.
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    lcp = [common(right[a], right[b]) for a, b in zip(order, order[1:])]
    place = {m: i for i, m in enumerate(order)}
    for depth, first, last in intervals(lcp):
        members = sorted(order[first : last + 1], key=left.__getitem__)
        sides = [common(left[a], left[b]) for a, b in zip(members, members[1:])]
        if max(sides) + middle + depth < least:
            continue
        for reach, a, b in intervals(sides):
            if reach + middle + depth < least:
                continue
            group = members[a : b + 1]
            places = [place[m] for m in group]
            if min(lcp[min(places) : max(places)]) == depth:  # else all go on alike, and a child has them
                yield reach, middle + depth, group


def resolve(length: int, gram: int):
    """Sorted runs of anchor groups -> repeated ranges (tk, lo, hi) of their occurrences."""

    def group(rows, out):
        if len(rows) < 2:
            return
        for reach, depth, members in maximal_repeats([r[2] for r in rows], [r[3] for r in rows], gram, length):
            out.update((rows[m][0], rows[m][1] - reach, rows[m][1] + depth) for m in members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            out: set[tuple[int, int, int]] = set()
            for h, *rest in zip(*(column(batch, n).to_pylist() for n in ("h", "tk", "pos", "left", "right")), strict=True):
                if h != now:
                    group(rows, out)
                    now, rows = h, []
                rows.append(rest)
            yield ranges(out)
        out = set()
        group(rows, out)
        yield ranges(out)

    return run


def ranges(out: set[tuple[int, int, int]]) -> pa.RecordBatch:
    tk, lo, hi = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(tk, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["tk", "lo", "hi"])


def windows(length: int, gram: int):
    """A hash of every window through an anchor, of its offset and the bytes beside it: rows (wh, tk, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, tk, pos, left, right in zip(*(column(batch, n).to_pylist() for n in ("h", "tk", "pos", "left", "right")), strict=True):
                raw = np.frombuffer(left[::-1] + right, dtype=np.uint8)
                sums = prefix_sums(raw)
                lefts = np.arange(max(0, length - gram - len(right)), min(len(left), length - gram) + 1)
                lo, hi = len(left) - lefts, len(left) + (length - gram - lefts)
                wh = mix(span_sums(sums, lo, hi) + mix(np.uint64(h & 0xFFFFFFFFFFFFFFFF) + lefts.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(wh.view(np.int64)), pa.array(np.full(len(wh), tk)), pa.array((pos - lefts).astype(np.int32))], names=["wh", "tk", "at"])

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """tk, spans: the maximal runs of bytes of each text (by key) that repeated strings cover."""
    spark = docs.sparkSession
    texts = docs.select("tk", "text")
    found = table(texts.mapInArrow(scan(length, gram), "h long, c long, tk long, pos int"))
    repeated = found.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    repeated = repeated.filter("n > 1").select("h", (F.col("lo") != F.col("hi")).alias("mixed"))
    hits = table(found.join(repeated, "h"))
    sweep(spark)
    per = hits.filter("mixed").groupBy("h", "c").agg(F.count("*").alias("n"), F.first("tk").alias("tk"), F.first("pos").alias("pos"))
    per = table(per)
    side = length - gram
    whole = hits.filter("not mixed").select("tk", "pos").unionByName(hits.filter("mixed").join(per.filter("n > 1").select("h", "c"), ["h", "c"]).select("tk", "pos"))
    whole = whole.distinct().select("tk", (F.col("pos") - side).alias("lo"), (F.col("pos") + length).alias("hi"))
    words = bitmap(per.select(spot_column().alias("k")), "k")
    sweep(spark)
    whole = table(whole)
    discard(hits, found)
    sizes = per.groupBy("h").agg(F.count("*").alias("d"))
    around = texts.mapInArrow(surroundings(length, gram, words), "h long, tk long, pos int, left binary, right binary")
    around = around.join(per.select("h", "tk", "pos"), ["h", "tk", "pos"], "left_semi").dropDuplicates(["h", "tk", "pos"])
    around = table(around.join(sizes, "h"))
    sweep(spark)
    small = around.filter(F.col("d") <= MOST).select("h", "tk", "pos", "left", "right")
    small = small.repartition("h").sortWithinPartitions("h").mapInArrow(resolve(length, gram), "tk long, lo int, hi int")
    large = around.filter(F.col("d") > MOST).mapInArrow(windows(length, gram), "wh long, tk long, at int")
    twice = large.groupBy("wh").agg(F.count("*").alias("n")).filter("n > 1").select("wh")
    large = large.join(twice, "wh").select("tk", F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))
    both = whole.unionByName(small).unionByName(large)
    spans = table(both.groupBy("tk").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    discard(whole, around, per)
    sweep(spark)
    return spans


def cut(batch: pa.RecordBatch, key: str = "doc_id") -> pa.RecordBatch:
    """The key, n_bytes, the maximal removed spans (byte ranges) and the bytes that are left."""
    data, offsets = utf8(column(batch, "text"))
    raw = data.tobytes()
    out_spans, kept, sizes = [], [], []
    spans_of = column(batch, "spans") if "spans" in batch.schema.names else pa.nulls(batch.num_rows)
    for i, spans in enumerate(spans_of):
        text = raw[offsets[i] : offsets[i + 1]]
        runs: list[list[int]] = []
        for lo, hi in sorted((max(0, s["lo"]), min(len(text), s["hi"])) for s in spans.as_py() or ()):
            if runs and lo <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], hi)
            else:
                runs.append([lo, hi])
        pieces, at = [], 0
        for lo, hi in runs:
            pieces.append(text[at:lo])
            at = hi
        out_spans.append([{"lo": a, "hi": b} for a, b in runs])
        kept.append(b"".join([*pieces, text[at:]]))
        sizes.append(len(text))
    return pa.RecordBatch.from_arrays(
        [column(batch, key), pa.array(sizes, pa.int64()), pa.array(out_spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), pa.array(kept, pa.binary())],
        names=[key, "n_bytes", "removed", "kept"],
    )


def digest(batch: pa.RecordBatch, key: str = "doc_id") -> pa.RecordBatch:
    """The contract's columns from the operator's."""
    batch = cut(batch, key)
    spans = column(batch, "removed").to_pylist()
    return pa.RecordBatch.from_arrays(
        [
            column(batch, key), column(batch, "n_bytes"), pa.array([sum(s["hi"] - s["lo"] for s in x) for x in spans], pa.int64()),
            pa.array([len(x) for x in spans], pa.int64()), pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in column(batch, "kept")]),
        ],
        names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def each(finish, words: np.ndarray):
    """`finish` on the rows whose text key isn't in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield finish(batch.filter(pa.array(~seen(words, column(batch, "tk").to_numpy()))))

    return run


def once(words: np.ndarray):
    """One row (tk, text) per text and task of those that may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            keys = column(batch, "tk").to_numpy()
            fresh = []
            for i in np.flatnonzero(seen(words, keys)).tolist():
                if (k := int(keys[i])) not in done:
                    done.add(k)
                    fresh.append(i)
            if len(done) > 1_000_000:
                done.clear()
            yield batch.take(pa.array(fresh, pa.int32()))

    return run


def first_of_each(finish):
    """`finish` on the first of neighbouring rows of one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = column(batch, "tk").to_numpy()
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            if len(keys):
                new[0] = keys[0] != last
                last = keys[-1]
            yield finish(batch.filter(pa.array(new)), "tk")

    return run


def finished(docs: DataFrame, finish, ddl: str, length: int, gram: int) -> DataFrame:
    """`finish` on every document and its repeated ranges.

    Texts that may have some are moved and cut once each, however many copies there are; the results
    go back to the documents by the text's key.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("tk", F.xxhash64("text"))
    spans = repeated_ranges(docs, length, gram)
    words = bitmap(spans, "tk")
    moved = docs.select("tk", "text").mapInArrow(once(words), "tk long, text string").join(spans, "tk", "left")
    done = table(moved.select("tk", "text", "spans").sortWithinPartitions("tk").mapInArrow(first_of_each(finish), f"tk long, {ddl}").dropDuplicates(["tk"]))
    rest = docs.mapInArrow(each(finish, words), f"doc_id long, {ddl}")
    return docs.select("doc_id", "tk").join(done, "tk").select(*rest.columns).unionByName(rest)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, removed (maximal byte ranges), kept (the remaining bytes)."""
    return finished(docs, cut, "n_bytes long, removed array<struct<lo:int,hi:int>>, kept binary", length, gram)


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return finished(docs, digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, gram)
