"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad.  Its features are those of the line and of its neighbours; the
chain couples neighbouring labels.  Forward-backward gives each line's marginal, and the document's
score is their mean, weighted by length.  A line of a training document has the document's label.

Null and empty texts are one empty line; lines of any length count in full; repeated rows are scored
alike; without labels the score is the prior 0.5; an empty table gives an empty result.
Features come from the text alone.  The only bound is on training: labelled documents, the first by
hash of doc_id, whole, up to `TRAIN_DOCS` of them and `TRAIN_LINES` lines in all (scoring has none).
Rows that are equal in doc_id and text are learnt from once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import aside, prepare
from .textops import NOT_SPACE, column, part, slices, utf8, words

TRAIN_DOCS = 6000
TRAIN_LINES = 400_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
STEPS, RATE, DECAY = 300, 0.1, 1e-3
SEED = 2
BASIC = 16
FEATURES = 3 * BASIC + 1


def per_byte(ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, dtype=np.float32)
    for lo, hi in ranges:
        out[lo : hi + 1] = 1
    return out


UPPER, LOWERS, DIGIT = per_byte([(65, 90)]), per_byte([(97, 122), (128, 255)]), per_byte([(48, 57)])
MARKS, ENDS, SPACES = per_byte([(33, 33), (35, 38), (42, 43), (47, 47), (60, 62), (64, 64), (91, 96), (123, 126)]), per_byte([(46, 46), (44, 44), (63, 63)]), per_byte([(9, 13), (32, 32)])


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines (a text without a line break is one), and each text's first line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    per = 1 + np.diff(np.searchsorted(breaks, offsets))
    return starts, ends, np.concatenate([[0], np.cumsum(per)])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all lines, their lengths, and each text's first line."""
    starts, ends, first = line_bounds(data, offsets)
    n = (ends - starts).astype(np.float32)
    safe = np.maximum(n, 1)

    def share(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values[data], dtype=np.float64)])
        return ((total[ends] - total[starts]) / safe).astype(np.float32)

    h, ws, we, _ = words(data, offsets, NOT_SPACE, SEED)
    a, b = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    count = (b - a).astype(np.float32)
    some = np.maximum(count, 1)

    def mean(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
        return ((total[b] - total[a]) / some).astype(np.float32)

    size = (we - ws).astype(np.float32)
    again = np.zeros(len(h), np.float32)
    again[1:] = h[1:] == h[:-1]
    near = np.zeros(len(h), np.float32)
    for d in (2, 3, 4):
        near[d:] = np.maximum(near[d:], h[d:] == h[:-d])
    letters = np.concatenate([[0], np.cumsum((UPPER + LOWERS)[data], dtype=np.float64)])
    bare = (letters[we] - letters[ws] == 0).astype(np.float32) if len(ws) else size
    last = MARKS[data[we - 1]] if len(ws) else size
    rows = np.stack(
        [np.log1p(n), np.log1p(count), share(UPPER), share(LOWERS), share(DIGIT), share(MARKS), share(ENDS), share(SPACES),
         np.minimum(mean(size), 40) / 10, mean(again), mean(near), mean(bare), mean(last), mean((size <= 3).astype(np.float32)), mean((size >= 9).astype(np.float32)),
         (count == 0).astype(np.float32)],
        axis=1,
    )
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    before[1:], after[:-1] = rows[:-1], rows[1:]
    before[first[:-1]], after[first[1:] - 1] = 0, 0
    return np.concatenate([rows, before, after, np.ones((len(rows), 1), np.float32)], axis=1), n, first


def layout(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts of similar line counts as (texts, line index by text and time, whether there)."""
    counts = np.diff(first)
    order = np.argsort(counts, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and counts[order[j]] <= max(8, 2 * counts[order[i]]) and (j - i + 1) * counts[order[j]] <= 200_000:
            j += 1
        rows = order[i:j]
        t = np.arange(counts[rows].max())
        there = t[None, :] < counts[rows][:, None]
        yield rows, np.where(there, first[rows][:, None] + t[None, :], 0), there
        i = j


def forward_backward(unary: np.ndarray, there: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Marginals (texts, time, 2), pairwise expectations (2, 2) and log partition of padded chains."""
    m, t, _ = unary.shape
    u = np.exp(unary - unary.max(axis=2, keepdims=True))
    lift = unary.max(axis=2)
    e = np.exp(trans)
    alpha, scale = np.zeros_like(u), np.ones((m, t))
    now = u[:, 0] * np.exp(start)
    for k in range(t):
        if k:
            now = np.where(there[:, k, None], (alpha[:, k - 1] @ e) * u[:, k], alpha[:, k - 1])
        total = now.sum(axis=1)
        scale[:, k] = np.where(there[:, k] | (k == 0), total, 1)
        alpha[:, k] = now / scale[:, k, None]
    beta = np.ones_like(u)
    pair = np.zeros((2, 2))
    for k in range(t - 2, -1, -1):
        step = (u[:, k + 1] * beta[:, k + 1]) / scale[:, k + 1, None]
        live = there[:, k + 1]
        beta[:, k] = np.where(live[:, None], step @ e.T, 1)
        pair += (alpha[live, k].T @ step[live]) * e
    both = alpha * beta
    return both / both.sum(axis=2, keepdims=True), pair, (np.log(scale) + np.where(there, lift, 0)).sum()


def fit(x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Maximum conditional likelihood by Adam; the two labels weigh the same."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    z = ((x - mean) / scale).astype(np.float64)
    groups = list(layout(first))
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    p = {"w": np.zeros(x.shape[1]), "trans": np.zeros((2, 2)), "start": np.zeros(2)}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    total = len(z)
    for step in range(1, STEPS + 1):
        g = {k: DECAY * a for k, a in p.items()}
        score = z @ p["w"]
        for rows, at, there in groups:
            unary = np.stack([np.zeros(at.shape), score[at]], axis=2)
            for label in (0, 1):
                own = labels[rows] == label
                if not own.any():
                    continue
                marg, pair, _ = forward_backward(unary[own], there[own], p["trans"], p["start"])
                lines = at[own][there[own]]
                part_weight = float(weight[rows][own][0])
                g["w"] += part_weight / total * (z[lines].T @ (marg[there[own]][:, 1] - label))
                want = np.zeros((2, 2))
                want[label, label] = (there[own].sum(axis=1) - 1).sum()
                g["trans"] += part_weight / total * (pair - want)
                begin = np.zeros(2)
                begin[label] = own.sum()
                g["start"] += part_weight / total * (marg[:, 0].sum(axis=0) - begin)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p | {"mean": mean.astype(np.float64), "scale": scale.astype(np.float64)}


def scores(data: np.ndarray, offsets: np.ndarray, model: dict[str, np.ndarray] | None) -> np.ndarray:
    """The length-weighted mean marginal of every text."""
    if model is None:
        return np.full(len(offsets) - 1, 0.5)
    x, n, first = features(data, offsets)
    score = ((x - model["mean"]) / model["scale"]) @ model["w"]
    out = np.zeros(len(offsets) - 1)
    weight = n + 1.0
    for rows, at, there in layout(first):
        unary = np.stack([np.zeros(at.shape), score[at]], axis=2)
        marg, _, _ = forward_backward(unary, there, model["trans"], model["start"])
        w = np.where(there, weight[at], 0)
        out[rows] = (marg[:, :, 1] * w).sum(axis=1) / w.sum(axis=1)
    return np.clip(out, 0, 1)


def line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature rows of all lines of training documents, as float32 bytes."""
    for batch in batches:
        data, offsets = utf8(column(batch, "text"))
        out: list[bytes] = []
        for i, j in slices(offsets):
            x, _, first = features(*part(data, offsets, i, j))
            out.extend(x[a:b].astype(np.float32).tobytes() for a, b in zip(first, first[1:]))
        yield pa.RecordBatch.from_arrays([column(batch, "label"), pa.array(out, pa.binary())], names=["label", "x"])


def fold(doc_id):
    return F.crc32(doc_id.cast("string")) % FOLDS


def train(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | None:
    """Fit on labelled rows outside the held-out fold; at most `TRAIN_DOCS` of them."""
    prepare(docs.sparkSession)
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    rows = rows.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"))
    chosen = rows.orderBy(F.xxhash64("id"), "id", "label").limit(TRAIN_DOCS)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").alias("id"), text.alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tk"))
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(1))
    keys = texts.join(F.broadcast(chosen), "id").select("id", "label", "tk", lines.alias("lines")).distinct()
    taken, total = [], 0
    for r in keys.orderBy(F.xxhash64("id"), "id", "label", "tk").limit(TRAIN_DOCS).collect():
        total += r.lines
        if taken and total > TRAIN_LINES:
            break
        taken.append((r.id, r.label, r.tk))
    if not taken:
        return None
    wanted = docs.sparkSession.createDataFrame(taken, f"id {texts.schema['id'].dataType.simpleString()}, label int, tk long")
    got = texts.join(F.broadcast(wanted), ["id", "tk"]).dropDuplicates(["id", "tk", "label"]).select("label", "text").mapInArrow(line_rows, "label int, x binary").toArrow()
    if not got.num_rows:
        return None
    order = sorted(range(got.num_rows), key=lambda i: (got["x"][i].as_py(), got["label"][i].as_py()))
    parts = [np.frombuffer(got["x"][i].as_py(), np.float32).reshape(-1, FEATURES) for i in order]
    y = np.array([got["label"][i].as_py() for i in order])
    if len(set(y.tolist())) < 2:
        return None
    return fit(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), y)


def scorer(model: dict[str, np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            score = np.zeros(batch.num_rows)
            for i, j in slices(offsets):
                score[i:j] = scores(*part(data, offsets, i, j), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "quality_score"])

    return run


def with_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with quality_score (a column of that name is replaced)."""
    prepare(docs.sparkSession)
    docs = docs.drop("quality_score")
    model = train(docs, labels)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "quality_score double"])
    return docs.mapInArrow(scorer(model), schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = with_score(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels)
    return rows.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold."""
    plain, back = aside(docs, "doc_id", "text")
    return back(with_score(plain, labels).filter(F.col("quality_score") >= threshold))
