"""LM scoring by masked pseudo-likelihood, with a bidirectional window network in numpy.

Every token is predicted from the tokens on both sides of it; the score of a document is the sum of
its tokens' conditional log-probabilities.  Tokens are words, lower case, hashed to `FINE` buckets,
which are ranked by their count in the corpus.  The network sees `2 * SIDE` neighbours through
embeddings (the most frequent buckets have their own, the others share) and predicts the token's
class by a hierarchical soft-max of two levels, starting from the corpus frequencies.  The most
frequent buckets are a class each; the others share `SHARED` classes, within which a bucket has its
smoothed corpus frequency.

Counts cover every token of every document, and the network is trained on every one, in a single
pass.  The corpus is cut into shards by a hash of doc_id and text, as many as its tokens ask for
(`SHARD_TOKENS`), each in the order of that hash: however the input is split, the model is the same
but for rounding.  Each shard trains from the same start, and the parameters are averaged, weighted
by tokens, block by block on the executors.  What is sent to the driver and back is the model and
the counts, whose sizes are fixed; what is gathered grows with the corpus.

Null, empty and blank texts have no token and score 0 (no mean); one token is predicted from empty
sides; texts of any length are scored in full; repeated rows score alike; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import prepare
from .textops import NOT_SPACE, column, part, slices, utf8, words

SIDE, VOCAB, DIM, HIDDEN, HEAD = 2, 8192, 16, 32, 32
FINE = 1 << 18
#: Classes that the rarer buckets share, of HEAD * HEAD.
SHARED = 64
#: Steps start with batches of the first size and end with the second, a `GROWTH`-th of the tokens seen.
BATCH, GROWTH, RATE = (64, 1024), 64, 0.15
#: Tokens of a shard, about.
SHARD_TOKENS = 2_000_000
BLOCK, CHUNK = 1024, 32768
SEED = 5
SHAPES = {"emb": (VOCAB + 1, DIM), "w1": (2 * SIDE * DIM, HIDDEN), "b1": (HIDDEN,), "top": (HIDDEN, HEAD), "low": (HEAD, HIDDEN, HEAD)}


def initial() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(5)
    emb = rng.standard_normal(SHAPES["emb"]) * 0.5
    w1 = rng.standard_normal(SHAPES["w1"]) / np.sqrt(2 * SIDE * DIM)
    return {"emb": emb.astype(np.float32), "w1": w1.astype(np.float32)} | {k: np.zeros(SHAPES[k], np.float32) for k in ("b1", "top", "low")}


class Vocabulary:
    """Buckets by corpus count: their input ids and classes, and the smoothed frequencies log P(upper), P(lower | upper), P(bucket | class)."""

    def __init__(self, counts: np.ndarray):
        rank = np.empty(FINE, np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(FINE)
        half = VOCAB // 2
        self.ids = np.where(rank < half, rank, half + (np.arange(FINE) & (half - 1))).astype(np.int32)
        own = HEAD * HEAD - SHARED
        place = np.where(rank < own, rank, own + rank % SHARED)
        # neighbours in rank are under different upper classes, so that these weigh about the same
        self.classes = (place % HEAD * HEAD + place // HEAD).astype(np.int32)
        per = np.bincount(self.classes, counts + 1.0, HEAD * HEAD)
        low = per.reshape(HEAD, HEAD)
        self.top = np.log(low.sum(axis=1) / low.sum()).astype(np.float32)
        self.low = np.log(low / low.sum(axis=1, keepdims=True)).astype(np.float32)
        self.rest = np.log((counts + 1.0) / per[self.classes]).astype(np.float32)


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        out[k] = values[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
        at += int(np.prod(s))
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all tokens and each row's first token."""
    h, _, _, bounds = words(data, offsets, NOT_SPACE, SEED)
    return (h & np.uint64(FINE - 1)).astype(np.int32), bounds


def contexts(ids: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids of the neighbours of the tokens `at`; VOCAB beyond the row."""
    row = np.searchsorted(bounds, at, side="right") - 1
    lo, hi = bounds[row], bounds[row + 1]
    out = np.full((len(at), 2 * SIDE), VOCAB, np.int32)
    for k, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        p = at + d
        ok = (p >= lo) & (p < hi)
        out[ok, k] = ids[p[ok]]
    return out


def hidden(p: dict[str, np.ndarray], ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = p["emb"].take(ctx, axis=0).reshape(len(ctx), -1)
    return x, np.tanh(x @ p["w1"] + p["b1"])


ONES = np.ones((HEAD, 1), np.float32)


def highest(z: np.ndarray) -> np.ndarray:
    """The largest of each of many short rows, column by column, which is several times as fast as row by row."""
    out = np.empty((len(z), 1), z.dtype)
    for i in range(0, len(z), BLOCK):  # as many rows as the nearest cache holds
        np.max(np.ascontiguousarray(z[i : i + BLOCK].T), axis=0, out=out[i : i + BLOCK, 0])
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = z - highest(z)
    np.exp(z, out=z)
    z /= z @ ONES
    return z


def step(p: dict[str, np.ndarray], sums: dict[str, np.ndarray], prior: Vocabulary, ctx: np.ndarray, target: np.ndarray) -> None:
    """One Adagrad step on a batch of contexts and target classes."""
    n, rows = len(ctx), np.arange(len(ctx))
    x, h = hidden(p, ctx)
    upper, lower = target // HEAD, target % HEAD
    # tokens of one upper class stand together, in a block of rows that is as high as the largest class
    order = np.argsort(upper, kind="stable")
    edges = np.searchsorted(upper[order], np.arange(HEAD + 1))
    high = int(np.diff(edges).max())
    place = np.empty(n, np.int64)
    place[order] = rows - edges[upper[order]] + upper[order] * high
    hs, ds = np.zeros((HEAD * high, HIDDEN), np.float32), np.zeros((HEAD * high, HEAD), np.float32)
    hs[place] = h
    by_class = lambda a, b: np.matmul(a.reshape(HEAD, high, -1), b).reshape(len(a), -1).take(place, axis=0)
    d1 = softmax(h @ p["top"] + prior.top)
    d2 = softmax(by_class(hs, p["low"]) + prior.low.take(upper, axis=0))
    d1[rows, upper] -= 1
    d2[rows, lower] -= 1
    d1 /= n
    d2 /= n
    ds[place] = d2
    dh = (d1 @ p["top"].T + by_class(ds, p["low"].transpose(0, 2, 1))) * (1 - h * h)
    dlow = np.matmul(hs.reshape(HEAD, high, -1).transpose(0, 2, 1), ds.reshape(HEAD, high, -1))
    dx = dh @ p["w1"].T
    order = np.argsort(ctx, axis=None)
    ids = ctx.ravel()[order]
    new = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
    which = ids[new]
    de = np.add.reduceat(dx.reshape(-1, DIM).take(order, axis=0), new, axis=0)
    for k, g in (("w1", x.T @ dh), ("b1", dh.sum(axis=0)), ("top", h.T @ d1), ("low", dlow)):
        sums[k] += g * g
        p[k] -= RATE * g / np.sqrt(sums[k] + 1e-8)
    total = sums["emb"].take(which, axis=0) + de * de
    sums["emb"][which] = total
    p["emb"][which] = p["emb"].take(which, axis=0) - RATE * de / np.sqrt(total + 1e-8)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's token counts by bucket."""
    counts = np.zeros(FINE, np.int64)
    for batch in batches:
        data, offsets = utf8(column(batch, "text"))
        for i, j in slices(offsets):
            counts += np.bincount(tokens(*part(data, offsets, i, j))[0], minlength=FINE)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])


def trained(slices_: Iterator[tuple[np.ndarray, np.ndarray]], vocabulary: Vocabulary) -> tuple[dict[str, np.ndarray], int]:
    """Parameters trained on every token of slices (buckets, bounds), and their number."""
    p = initial()
    sums = {k: np.full_like(v, 1e-4) for k, v in p.items()}
    seen, held = 0, []

    def learn() -> None:
        nonlocal seen
        ctx, target = np.concatenate([c for c, _ in held]), np.concatenate([t for _, t in held])
        held.clear()
        order = np.random.default_rng(len(ctx)).permutation(len(ctx))
        ctx, target = ctx[order], target[order]
        i = 0
        while i < len(ctx):
            size = min(BATCH[1], max(BATCH[0], seen // GROWTH))
            step(p, sums, vocabulary, ctx[i : i + size], target[i : i + size])
            i += size
            seen += size
        seen -= i - len(ctx)

    for bucket, bounds in slices_:
        held.append((contexts(vocabulary.ids[bucket], bounds, np.arange(len(bucket))), vocabulary.classes[bucket]))
        if sum(len(t) for _, t in held) >= 32 * BATCH[1]:
            learn()
    if held:
        learn()
    return p, seen


def learner(counts: np.ndarray):
    """The parameters of each shard of neighbouring rows: block, shard, weight (training tokens), float32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(counts)
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

        def pieces() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for batch in batches:
                shards = column(batch, "shard").to_numpy()
                data, offsets = utf8(column(batch, "text"))
                cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:]):
                    own, at = part(data, offsets, a, b)
                    for i, j in slices(at) if b > a else ():
                        yield int(shards[a]), *tokens(*part(own, at, i, j))

        source = pieces()

        def of(shard: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            while waiting or (got := next(source, None)):
                item = waiting.pop() if waiting else got
                if item[0] != shard:
                    waiting.append(item)
                    return
                yield item[1], item[2]

        while waiting or (got := next(source, None)):
            if not waiting:
                waiting.append(got)
            shard = waiting[0][0]
            p, n = trained(of(shard), vocabulary)
            values = flat(p)
            parts = [values[i : i + BLOCK].tobytes() for i in range(0, len(values), BLOCK)] if n else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([shard] * len(parts), pa.int64()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())],
                names=["key", "shard", "n", "value"],
            )

    return run


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted means of parameter blocks; a block's copies are added up one after the other."""
    sums: dict[int, tuple[np.ndarray, int]] = {}
    for batch in batches:
        for key, n, value in zip(*(column(batch, c).to_pylist() for c in ("key", "n", "value")), strict=True):
            old, weight = sums.get(key, (0.0, 0))
            sums[key] = (old + np.frombuffer(value, np.float32).astype(np.float64) * n, weight + n)
    keys = list(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int32()), pa.array([(sums[k][0] / sums[k][1]).astype(np.float32).tobytes() for k in keys], pa.binary())], names=["key", "value"]
    )


def train(docs: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The averaged parameters and the corpus counts of the buckets."""
    counts = np.zeros(FINE, np.int64)
    got = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[got["bucket"].to_numpy()] = got["n"].to_numpy()
    shards = max(1, -(-int(counts.sum()) // SHARD_TOKENS))
    rows = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").withColumn("shard", F.pmod(F.col("h"), F.lit(shards)))
    rows = rows.filter("text is not null").repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "h")
    found = rows.select("shard", "text").mapInArrow(learner(counts), "key int, shard long, n long, value binary")
    blocks = found.repartition("key").sortWithinPartitions("key", "shard").mapInArrow(merged, "key int, value binary").toArrow()
    parts = dict(zip(blocks["key"].to_pylist(), blocks["value"].to_pylist(), strict=True))
    return shaped(np.frombuffer(b"".join(parts[k] for k in sorted(parts)), np.float32)) if parts else initial(), counts


def log_likelihoods(params: dict[str, np.ndarray], prior: Vocabulary, bucket: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log P(token | both sides) of all tokens."""
    out = np.empty(len(bucket), np.float64)
    ids, target = prior.ids[bucket], prior.classes[bucket]
    for a in range(0, len(ids), CHUNK):
        at = np.arange(a, min(a + CHUNK, len(ids)))
        upper = target[at] // HEAD
        order = np.argsort(upper, kind="stable")
        at, upper = at[order], upper[order]
        lower = target[at] % HEAD
        _, h = hidden(params, contexts(ids, bounds, at))
        z1, z2 = h @ params["top"] + prior.top, np.empty((len(at), HEAD), np.float32)
        edges = np.searchsorted(upper, np.arange(HEAD + 1))
        for u in range(HEAD):
            own = slice(edges[u], edges[u + 1])
            z2[own] = h[own] @ params["low"][u] + prior.low[u]
        rows = np.arange(len(at))
        out[at] = prior.rest[bucket[at]]
        for z, k in ((z1, upper), (z2, lower)):
            z -= highest(z)
            found = z[rows, k]
            out[at] += found - np.log(np.exp(z, out=z) @ ONES).ravel()
    return out


def scorer(params: dict[str, np.ndarray], counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior = Vocabulary(counts)
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, j in slices(offsets):
                bucket, bounds = tokens(*part(data, offsets, i, j))
                sums = np.concatenate([[0], np.cumsum(log_likelihoods(params, prior, bucket, bounds))])
                n[i:j] = np.diff(bounds)
                total[i:j] = np.where(n[i:j] > 0, sums[bounds[1:]] - sums[bounds[:-1]], 0)
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n), pa.array(total), mean], names=["doc_id", "n_tokens", "pll", "pll_per_token"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, pll (summed log-probability) and pll_per_token, by a model trained on `docs`."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    params, counts = train(docs)
    return docs.mapInArrow(scorer(params, counts), "doc_id long, n_tokens long, pll double, pll_per_token double")
