"""Benchmark decontamination: a hash set of normalised test n-grams, scanned over training windows.

The hash set is sent to the tasks only if the benchmark's texts hold no more than `SENT_BYTES`.  The
windows of a larger benchmark are a table; documents' windows that pass a bitmap of bounded size are
joined with it.  Either way a hit is verified by its words, and texts are looked up once each in the
join, however many copies there are.

Null texts and texts without words have no window and are never hit; an empty benchmark hits
nothing; repeated document rows are judged each on its own; items with equal windows all count.
Items with a null item_id hit like any other; together they count as one item, which the digest of
items leaves out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import aside, bitmap, prepare, seen, table
from .textops import ALNUM, LOWER, column, inside, part, slices, utf8, window_hashes, word_counts, word_spans, words

WINDOW = 13
#: A document is contaminated if at least this share of its words is hit.
SHARE = (1, 20)
#: The most bytes of benchmark texts that are sent to every task.
SENT_BYTES = 4 << 20
SEED = 9


def normal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, k: int) -> bytes:
    """The k words from word `at` on, lower case, joined by a blank."""
    return b" ".join(LOWER[data[starts[i] : ends[i]]].tobytes() for i in range(at, at + k))


def in_order(items: set[str | None]) -> list[str | None]:
    """Sorted, null last."""
    return sorted(items, key=lambda x: (x is None, x or ""))


def test_windows(items: list[tuple[str | None, str]], window: int) -> dict[int, dict[int, dict[bytes, set[str | None]]]]:
    """Window length -> hash -> normalised words -> the items that have them."""
    out: dict[int, dict[int, dict[bytes, set[str]]]] = {}
    for item, text in items:
        data, offsets = utf8(pa.array([text], pa.string()))
        h, starts, ends, _ = words(data, offsets, ALNUM, SEED)
        k = min(window, len(h))
        if k == 0:
            continue
        for at, x in enumerate(window_hashes(h, k).tolist()):
            out.setdefault(k, {}).setdefault(x, {}).setdefault(normal(data, starts, ends, at, k), set()).add(item)
    return out


#: The windows of the benchmark that this worker has built last.
_BUILT: dict[tuple, tuple] = {}


def built(items: list[tuple[str | None, str]], window: int):
    """The windows of `items` and their sorted hashes, built once a worker."""
    key = (window, hashlib.sha256(repr(items).encode()).digest())
    if key not in _BUILT:
        known = test_windows(items, window)
        _BUILT.clear()
        _BUILT[key] = known, {k: np.sort(np.fromiter(v, np.uint64, len(v))) for k, v in known.items()}
    return _BUILT[key]


def runs(hits: list[tuple[int, int]], n: int) -> np.ndarray:
    """The maximal runs [from, to) of n words that are covered by hits (word, length)."""
    marks = np.zeros(n + 1, np.int32)
    for p, k in hits:
        marks[p] += 1
        marks[p + k] -= 1
    covered = np.concatenate([[False], np.cumsum(marks[:-1]) > 0, [False]])
    return np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)


def scanner(items: list[tuple[str | None, str]], window: int):
    """A function over Arrow batches that finds, per document, hit word ranges and hitting items."""

    def one(data, offsets, known, sorted_hashes):
        h, starts, ends, bounds = words(data, offsets, ALNUM, SEED)
        found: dict[int, list[tuple[int, int, set[str | None]]]] = {}
        for k, have in sorted_hashes.items():
            win = window_hashes(h, k)
            if not len(win):
                continue
            at = np.minimum(np.searchsorted(have, win), len(have) - 1)
            for p in np.flatnonzero((have[at] == win) & inside(bounds, k)).tolist():
                who = known[k][int(win[p])].get(normal(data, starts, ends, p, k))
                if who:
                    found.setdefault(int(np.searchsorted(bounds, p, side="right")) - 1, []).append((p, k, who))
        return starts, ends, bounds, found

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sorted_hashes = built(items, window)
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            n_words, n_hit = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            items_of: list[list[str | None]] = [[]] * batch.num_rows
            spans: list[list[dict]] = [[]] * batch.num_rows
            for i, j in slices(offsets):
                starts, ends, bounds, found = one(*part(data, offsets, i, j), known, sorted_hashes)
                n_words[i:j] = np.diff(bounds)
                for row, hits in found.items():
                    edges = runs([(p - int(bounds[row]), k) for p, k, _ in hits], int(bounds[row + 1] - bounds[row]))
                    n_hit[i + row] = int((edges[:, 1] - edges[:, 0]).sum())
                    items_of[i + row] = in_order(set().union(*(who for _, _, who in hits)))
                    base, first = offsets[i + row] - offsets[i], bounds[row]
                    spans[i + row] = [{"word_from": int(a), "word_to": int(b), "byte_from": int(starts[first + a] - base), "byte_to": int(ends[first + b - 1] - base)} for a, b in edges]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words), pa.array(n_hit), pa.array(items_of, pa.list_(pa.string())), pa.array(spans, SPANS)],
                names=[*batch.schema.names, "n_words", "n_hit", "items", "spans"],
            )

    return scan


SPANS = pa.list_(pa.struct([("word_from", pa.int32()), ("word_to", pa.int32()), ("byte_from", pa.int64()), ("byte_to", pa.int64())]))
SPANS_DDL = "array<struct<word_from:int,word_to:int,byte_from:bigint,byte_to:bigint>>"


def window_rows(window: int):
    """The windows of benchmark items: rows (k, h, words, item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(column(batch, "item").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                rows = [(k, h, words_, item) for k, by_hash in test_windows([(item, text or "")], window).items() for h, by_words in by_hash.items() for words_ in by_words]
                ks, hs, ws, who = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(np.array(hs, np.uint64).view(np.int64)), pa.array(ws, pa.binary()), pa.array(who, pa.string())], names=["k", "h", "words", "item"])

    return run


def candidates(lengths: list[int], known: np.ndarray):
    """The windows of documents whose hashes may be in the bitmap, one text per key and task: rows (t1, t2, pos, k, h, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(column(batch, "t1").to_pylist(), column(batch, "t2").to_pylist(), strict=True))
            fresh = [i for i, k in enumerate(keys) if k not in done and not done.add(k)]
            if len(done) > 1_000_000:
                done.clear()
            batch = batch.take(pa.array(fresh, pa.int32()))
            data, offsets = utf8(column(batch, "text"))
            for i, j in slices(offsets):
                d, o = part(data, offsets, i, j)
                h, starts, ends, bounds = words(d, o, ALNUM, SEED)
                for k in lengths:
                    win = window_hashes(h, k)
                    at = np.flatnonzero(inside(bounds, k) & seen(known, win.view(np.int64))) if len(win) else np.zeros(0, np.int64)
                    row = np.searchsorted(bounds, at, side="right") - 1
                    t1, t2 = (column(batch, c).to_numpy()[i:j][row] for c in ("t1", "t2"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t1), pa.array(t2), pa.array((at - bounds[row]).astype(np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(win[at].view(np.int64)),
                         pa.array([normal(d, starts, ends, p, k) for p in at.tolist()], pa.binary())],
                        names=["t1", "t2", "pos", "k", "h", "words"],
                    )

    return run


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of hits for documents with `hits` (word, length) and `who`, their items; both may be null."""
    for batch in batches:
        data, offsets = utf8(column(batch, "text"))
        n_words, n_hit, items, spans = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [], []
        found, who = (column(batch, c).to_pylist() for c in ("hits", "who"))
        for i in range(batch.num_rows):
            starts, ends = word_spans(*part(data, offsets, i, i + 1), ALNUM)
            n_words[i] = len(starts)
            edges = runs([(x["pos"], x["k"]) for x in found[i] or ()], len(starts))
            n_hit[i] = int((edges[:, 1] - edges[:, 0]).sum())
            items.append(in_order({x["item"] for x in who[i] or ()}))
            spans.append([{"word_from": int(a), "word_to": int(b), "byte_from": int(starts[a]), "byte_to": int(ends[b - 1])} for a, b in edges])
        rest = [n for n in batch.schema.names if n not in ("hits", "who")]
        yield pa.RecordBatch.from_arrays(
            [*(column(batch, n) for n in rest), pa.array(n_words), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, SPANS)],
            names=[*rest, "n_words", "n_hit", "items", "spans"],
        )


def unhit(known: np.ndarray):
    """The columns of hits for the documents whose text key isn't in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~seen(known, column(batch, "_t1").to_numpy())))
            data, offsets = utf8(column(batch, "text"))
            rest = [n for n in batch.schema.names if n not in ("_t1", "_t2")]
            n = batch.num_rows
            none = [pa.array([[]] * n, pa.list_(pa.string())), pa.array([[]] * n, SPANS)]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in rest), pa.array(word_counts(data, offsets, ALNUM).astype(np.int64)), pa.array(np.zeros(n, np.int64)), *none], names=[*rest, "n_words", "n_hit", "items", "spans"])

    return run


def joined_hits(docs: DataFrame, tests: DataFrame, window: int, schema: str) -> DataFrame:
    """What `scanner` finds, by a join of window hashes and words; nothing that is sent grows with either table."""
    wins = table(tests.mapInArrow(window_rows(window), "k int, h long, words binary, item string").distinct())
    lengths = sorted(r.k for r in wins.select("k").distinct().collect())  # `window` of them at most
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit(1), text)})
    found = keyed.select(F.col("_t1").alias("t1"), F.col("_t2").alias("t2"), "text").mapInArrow(candidates(lengths, bitmap(wins, "h", 27)), "t1 long, t2 long, pos int, k int, h long, words binary")
    hits = table(found.join(wins, ["k", "h", "words"]).select("t1", "t2", "pos", "k", "item").distinct())
    per = hits.groupBy(F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).agg(F.collect_set(F.struct("pos", "k")).alias("hits"), F.collect_set(F.struct("item")).alias("who"))
    known = bitmap(hits.select("t1").distinct(), "t1")
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    may = keyed.mapInArrow(lambda batches: (b.filter(pa.array(seen(known, column(b, "_t1").to_numpy()))) for b in batches), plain)
    may = may.join(per, ["_t1", "_t2"], "left").select(*docs.columns, "hits", "who").mapInArrow(counted, schema)
    return may.unionByName(keyed.mapInArrow(unhit(known), schema))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int | None = None) -> DataFrame:
    """`docs` with n_words, n_hit, items (sorted, null last) and the hit spans, in words and bytes of the text.

    A column of `docs` that has one of these names is replaced.
    """
    prepare(docs.sparkSession)
    clash = [c for c in docs.columns if c.lower() in ("n_words", "n_hit", "items", "spans")]
    docs = docs.drop(*clash).withColumn("text", F.col("text").cast("string"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_words long, n_hit long, items array<string>", f"spans {SPANS_DDL}"])
    tests = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = tests.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16)).first()[0] or 0
    if size > (SENT_BYTES if most_bytes is None else most_bytes):
        return joined_hits(docs, tests, window, schema)
    return docs.mapInArrow(scanner([tuple(r) for r in tests.collect()], window), schema)


def contaminated(n_hit, n_words, share: tuple[int, int] = SHARE):
    return (n_hit > 0) & (n_hit * share[1] >= n_words * share[0])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, hitting items, their digest and the contamination verdict."""
    found = find_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = column(batch, "text").to_pylist(), column(batch, "spans").to_pylist()
        out = []
        for text, cuts in zip(texts, spans, strict=True):
            if text is not None and cuts:
                raw, pieces, at = text.encode(), [], 0
                for s in cuts:
                    pieces.append(raw[at : s["byte_from"]])
                    at = s["byte_to"]
                text = b"".join([*pieces, raw[at:]]).decode()
            out.append(text)
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents") -> DataFrame:
    """Drop contaminated documents (`documents`), or cut every hit span out of its text (`spans`)."""
    plain, back = aside(docs, "text")
    found = find_hits(plain, benchmark, window)
    if remove == "documents":
        return back(found.filter(~contaminated(F.col("n_hit"), F.col("n_words"))))
    kept = found.select(*plain.columns, "spans")
    return back(kept.mapInArrow(cut_spans, kept.schema))
