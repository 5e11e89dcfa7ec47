"""Every corpus operator against brute force on a small table with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytelens.llm import (
    chat_collapse, components, decontaminate, line_dedup, media_sequences, mixing, ngram_join, pseudo_lm, quality_crf, scratch, suffix_dedup, textops, unit_dedup,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


def corpus():
    rng = random.Random(1)
    shared = prose(rng, 70)
    texts = [None, "", " \n\t ", "one", "One ", "Ünïcode wörds hère", "!!", "a b c", "A  b\tc"]
    base = [prose(rng, rng.randrange(30, 200)) for _ in range(12)]
    texts += base + base[:3]
    for t in base[:4]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [f"{prose(rng, 20)}\n{shared}\n{prose(rng, 30)}" for _ in range(5)]
    texts += ["ab" * 400, "ab" * 150 + "c", "x" * 199, "x" * 200, "x" * 201, prose(rng, 30000, 5000)]
    texts += ["\n".join(prose(rng, 12, 40) for _ in range(8)) for _ in range(4)]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[9], rows[10], (None, "a document without a number", None, "src1", 5), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).withColumns({c: F.lit(7) for c in ("n", "ent", "token", "size", "spans", "rank", "tk", "line_no")}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- text kernels -------------------------------------------------------------------------------


def test_words_match_the_pattern():
    texts = [t for _, t, *_ in corpus()]
    data, offsets = textops.utf8(pa.array(texts, pa.string()))
    for table, pattern in ((textops.NOT_SPACE, rb"[^\x20\x09-\x0D]+"), (textops.ALNUM, rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        h, starts, ends, bounds = textops.words(data, offsets, table, 1)
        raw = data.tobytes()
        got = [[raw[a:b] for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(bounds, bounds[1:])]
        assert got == [re.findall(pattern, (t or "").encode()) for t in texts]
        flat = [w.lower() for row in got for w in row]
        assert len(set(flat)) == len(set(h.tolist())) == len(set(zip(flat, h.tolist())))


def thue_morse(n, a, b):
    """Two sequences of 2**n symbols that a polynomial hash modulo 2**64 can't tell apart."""
    bits = np.array([0])
    for _ in range(n):
        bits = np.concatenate([bits, 1 - bits])
    return [[(a, b)[x] for x in bits ^ flip] for flip in (0, 1)]


@pytest.mark.parametrize("n", [10, 11, 12])
def test_hashes_tell_structured_texts_apart(n):
    one, two = ("".join(x) for x in thue_morse(n, "a", "b"))
    data, offsets = textops.utf8(pa.array([one, two, one + "c", "x " + one], pa.string()))
    h, *_ = textops.words(data, offsets, textops.NOT_SPACE, 1)
    assert len(set(h.tolist())) == 4 and h[0] == h[4]
    sums = textops.prefix_sums(data)
    lo, hi = offsets[:3], offsets[:3] + len(one)
    spans = textops.span_sums(sums, lo, hi)
    assert spans[0] != spans[1] and spans[0] == spans[2]
    seqs = np.array([int(x) for s in thue_morse(n, 17, 99) for x in s], np.uint64)
    a = np.array([0, len(one)])
    for d in unit_dedup.digests(textops.mix(seqs), a, a + len(one)):
        assert d[0] != d[1]


def test_structured_texts_stay(spark):
    texts = [" ".join(x) for x in thue_morse(10, "alpha", "beta")] + ["".join(x) + " x y z" for x in thue_morse(10, "a", "b")] + ["".join(x) for x in thue_morse(8, "ab", "cd")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.n_removed for r in unit_dedup.remove_later(df).collect()} == {0}
    words = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if " " not in t or "x y" in t], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.components_of(words, 4, (85, 100)).collect()} == {i: i for i in range(2, 6)}
    want = repeats([t.encode() for t in texts], 200)
    assert sorted(tuple(r)[1:] for r in suffix_dedup.report(df).collect()) == sorted(want)
    bench = spark.createDataFrame([(1, texts[2].split()[0])], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.report(df, bench).collect() if r.n_hit] == [2]


def test_slices_cover_all_rows_once():
    offsets = np.array([0, 5, 5, 30, 31, 90])
    assert list(textops.slices(offsets, 10)) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_bitmap_has_no_false_negative(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("k"))
    words = scratch.bitmap(keys, "k", 16)
    assert scratch.seen(words, np.array([r.k for r in keys.collect()])).all()
    assert scratch.seen(words, np.array([r.k for r in spark.range(5000, 9000).select(F.xxhash64("id").alias("k")).collect()])).mean() < 0.05


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (7, 7), (20, 21), (21, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 6)}, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20, **{100 + i: 100 for i in range(41)}}


# --- 1 suffix array -----------------------------------------------------------------------------


def repeats(texts, length):
    count = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            count[t[p : p + length]] = count.get(t[p : p + length], 0) + 1
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        spans = sum(1 for i, m in enumerate(mark) if m and (not i or not mark[i - 1]))
        out.append((len(t), sum(mark), spans, hashlib.sha256(bytes(b for b, m in zip(t, mark) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,most", [(200, 100, 512), (200, 100, 1), (40, 16, 512), (40, 16, 2)])
def test_repeats_are_removed(docs, monkeypatch, length, gram, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    want = repeats([(t or "").encode() for _, t, *_ in corpus()], length)
    want = sorted(((r[0], *w) for r, w in zip(corpus(), want)), key=repr)
    assert rows_of(suffix_dedup.report(docs, length, gram)) == want


def test_no_repeats_in_an_empty_table(empty):
    assert suffix_dedup.report(empty).collect() == []


def test_maximal_repeats_have_all_occurrences():
    texts = [b"xxabcdefyy", b"zzabcdefww", b"qqabcdexyy", b"kkkkcdefuu"]
    at = [t.index(b"cd") for t in texts]
    left, right = [t[:p][::-1] for t, p in zip(texts, at)], [t[p + 2 :] for t, p in zip(texts, at)]
    got = {(reach, depth, tuple(sorted(m))) for reach, depth, m in suffix_dedup.maximal_repeats(left, right, 2, 4)}
    assert got == {(2, 4, (0, 1)), (2, 3, (0, 1, 2)), (0, 4, (0, 1, 3))}


# --- 2 quality ----------------------------------------------------------------------------------


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    unary, trans, start = rng.normal(size=(1, 4, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    weights = {}
    for code in range(16):
        y = [(code >> k) & 1 for k in range(4)]
        weights[tuple(y)] = np.exp(start[y[0]] + sum(unary[0, k, y[k]] for k in range(4)) + sum(trans[y[k], y[k + 1]] for k in range(3)))
    z = sum(weights.values())
    marg, pair, log_z = quality_crf.forward_backward(unary, np.ones((1, 4), bool), trans, start)
    assert np.allclose(marg[0, :, 1], [sum(w for y, w in weights.items() if y[k]) / z for k in range(4)])
    assert np.allclose(pair, [[sum(w * sum(y[k : k + 2] == (a, b) for k in range(3)) for y, w in weights.items()) / z for b in (0, 1)] for a in (0, 1)])
    assert np.isclose(log_z, np.log(z))


def test_quality_is_learnt_and_held_out(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        lines = [prose(rng, 15) if good else " | ".join(prose(rng, 8).upper().split()) for _ in range(rng.randrange(1, 6))]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (None, "some words"), (5, rows[5][1])]
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_crf.report(d, y).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert len(held) > 40 and all(r.predicted == int(r.doc_id % 3 != 0) for r in held)
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert rows_of(quality_crf.report(d, flipped)) == rows_of(quality_crf.report(d, y))
    kept = quality_crf.keep_good(d.withColumn("quality_score", F.lit("clash")), y)
    assert kept.columns == ["doc_id", "text", "quality_score"] and {r.quality_score for r in kept.collect()} == {"clash"}


def test_quality_without_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_crf.report(docs, none).collect()} == {0.5}
    assert quality_crf.report(empty, none).collect() == []


# --- 3 units ------------------------------------------------------------------------------------


def unit_list(text, least=unit_dedup.SENTENCE_WORDS):
    """(lo, hi, words) of the lines and sentences, in bytes."""
    raw = text.encode()
    line_cuts = [0, *(m.end() for m in re.finditer(rb"\n", raw)), len(raw)]
    stops = [m.end() for m in re.finditer(rb"[.!?](?=[\t\n\r '\")]|$)", raw) if m.end() == len(raw) or raw[m.end() : m.end() + 1] in (b"\t", b"\n", b"\r", b" ", b'"', b"'", b")")]
    for cuts, n in ((line_cuts, 1), (line_cuts + stops, least)):
        cuts = sorted(set(cuts))
        for lo, hi in zip(cuts, cuts[1:]):
            w = re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", raw[lo:hi])
            if len(w) >= n:
                yield lo, hi, b" ".join(w).lower()


def test_later_units_go(docs, spark):
    odd = [(None, "one line that repeats"), (None, "one line that repeats"), (5, "another line here"), (5, "another line here"), (5, "another line here"), (5, "One line that repeats"), (None, "alone")]
    rows = [(r[0], r[1]) for r in corpus()] + odd
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string").repartition(3))
    got = sorted(((r.doc_id, r.text or "", [[s.lo, s.hi] for s in r.removed]) for r in unit_dedup.remove_later(df).collect()), key=repr)
    keys = F.xxhash64(F.coalesce("text", F.lit("")))
    tk = {r.text: r.k for r in df.select("text", keys.alias("k")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tk[r[1]]))
    first, want = {}, []
    for at, (i, t) in enumerate(order):
        raw, spans, merged = (t or "").encode(), [], []
        for lo, hi, w in sorted(unit_list(t or "")):
            if first.setdefault(w, (at, lo)) != (at, lo):  # a line and its only sentence start at one place
                spans.append((lo, hi))
        for lo, hi in sorted(spans):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        out, end = b"", 0
        for lo, hi in merged:
            out, end = out + raw[end:lo], hi
        want.append((i, (out + raw[end:]).decode(), merged))
    assert got == sorted(want, key=repr)


def test_no_units_in_an_empty_table(empty):
    assert unit_dedup.remove_later(empty).collect() == []


# --- 4 lines ------------------------------------------------------------------------------------


def lines_kept(rows, num=80, den=100):
    """doc_id -> the remaining lines, for rows of (doc_id, text, ...) with distinct ids."""
    lines = [(r[0], k, frozenset(x for x in ln.split(" ") if x)) for r in rows if r[1] is not None for k, ln in enumerate(r[1].split("\n"))]
    lines.sort(key=lambda x: x[:2])
    gone = set()
    for j, (doc, k, s) in enumerate(lines):
        if s and any(t and len(s & t) * den >= num * len(s | t) for _, _, t in lines[:j]):
            gone.add((doc, k))
    return {r[0]: None if r[1] is None else [ln for k, ln in enumerate(r[1].split("\n")) if (r[0], k) not in gone] for r in rows}


def test_line_dedup_is_exact(docs, spark):
    rng = random.Random(4)
    extra = []
    for i in range(60):
        w = [f"t{rng.randrange(12)}" for _ in range(rng.randrange(1, 14))]
        extra.append((500 + i, "\n".join([" ".join(w), " ".join(w[1:]), "", "  ".join(reversed(w))]), "en", "s", 1))
    rows = [r for r in corpus() if r[0] is not None] + extra
    rows = list({(r[0], r[1]): r for r in rows}.values())
    want = lines_kept(rows)
    got = line_dedup.report(spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1))).collect()
    assert {r.doc_id: r.text for r in got} == {k: None if v is None else "\n".join(v) for k, v in want.items()}
    text = {r[0]: r[1] for r in rows}
    assert all(r.n_removed == (0 if text[r.doc_id] is None else len(text[r.doc_id].split("\n")) - len(want[r.doc_id])) for r in got)


def test_line_dedup_tells_rows_apart(spark):
    rng = random.Random(14)
    a, b, c, d, e = (prose(rng, 12, 5000) for _ in range(5))
    rows = [(1, a), (None, a), (None, b), (None, b), (7, a + "\n" + c), (7, d), (7, d), (7, d), (7, d + " "), (9, e + "\n\n" + c), (9, e + "\n\n" + c), (None, None), (None, None), (8, ""), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tk = {r.text: r.k for r in df.select("text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("k")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tk[r[1]]))
    seen, want, stay = [], [], []
    for i, t in order:
        kept = []
        for line in [] if t is None else t.split("\n"):
            s = frozenset(x for x in line.split(" ") if x)
            if not s or not any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        want.append((i, None if t is None else "\n".join(kept)))
        stay += [t or ""] if t is None else ["\n".join(kept)] if kept else []
    got = line_dedup.report(df).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r.n_removed for r in got) == sum(len(t.split("\n")) for _, t in rows if t is not None) - sum(r.n_lines - r.n_removed for r in got)
    assert sorted((r.text or "") for r in line_dedup.drop_lines(df).collect()) == sorted(stay)


def test_wide_and_narrow_signatures_bound_the_difference(spark):
    rng = random.Random(15)
    sets = [[rng.getrandbits(63) for _ in range(n)] for n in (10, 60, 64, 70, 150)]
    sets += [s[: -len(s) // 8] + [rng.getrandbits(63) for _ in range(7)] for s in sets]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i long, ts array<long>")
    s1, s2 = line_dedup.parity(F.col("ts"))
    side = df.select(F.struct("i", s1.alias("s1"), s2.alias("s2")).alias("x"))
    rows = side.crossJoin(side.withColumnRenamed("x", "y")).select("x.i", F.col("y.i").alias("j"), line_dedup.differing("x", "y").alias("d")).collect()
    assert len(rows) == 100 and all(r.d <= len(set(sets[r.i]) ^ set(sets[r.j])) and (r.d == 0) == (r.i == r.j) for r in rows)


def test_line_dedup_evaluates_arrays_once(spark):
    """Distinct hashes are a column of their own, not below a lambda; a text is split once for its result."""
    text = "a b a  c\n\n \nb c a\n" + " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(1, text), (2, "a c b\nx"), (3, None), (4, "")], "doc_id long, text string")
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan(line_dedup.report(df)).count("split(") == 1
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.report(df).collect()}
    assert got == {1: (5, 1, text.replace("\nb c a\n", "\n")), 2: (2, 1, "x"), 3: (0, 0, None), 4: (1, 0, "")}
    dedup = line_dedup.Dedup(line_dedup.ranked(df))
    dedup.levels = line_dedup.rarity(dedup.docs)
    assert "transform(array_" not in plan(dedup.sets())
    assert sorted((r.n, r.s2 is None) for r in dedup.sets().collect()) == [(0, True)] * 3 + [(1, True)] + [(3, True)] * 3 + [(100, False)]


def test_line_dedup_keeps_columns(docs, empty):
    out = line_dedup.drop_lines(docs)
    assert out.columns == docs.columns
    assert all(r.text is None or r.text for r in out.collect() if r.doc_id != 1)
    assert line_dedup.report(empty).collect() == []


# --- 5 language model ---------------------------------------------------------------------------


def test_pseudo_likelihood(spark, docs, empty):
    rng = random.Random(5)
    pairs = [(f"k{i}", f"v{i}") for i in range(30)]
    rows = [(i, " ".join(w for _ in range(60) for w in rng.choice(pairs))) for i in range(150)]
    mixed = [(1000 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in rows[:40]]
    got = {r.doc_id: r for r in pseudo_lm.score(spark.createDataFrame(rows + mixed, "doc_id long, text string")).collect()}
    whole = sum(got[i].pll_per_token for i in range(40)) / 40
    assert whole > sum(got[1000 + i].pll_per_token for i in range(40)) / 40 + 0.05  # same words, another order
    odd = pseudo_lm.score(docs).collect()
    assert len(odd) == len(corpus())
    for r in odd:
        assert (r.n_tokens == 0) == (r.pll_per_token is None) and r.pll <= 0
    assert pseudo_lm.score(empty).collect() == []


def test_every_token_is_a_training_target():
    texts = pa.array([t for _, t, *_ in corpus()], pa.string())
    shards = pa.array(sorted(i % 3 for i in range(len(texts))), pa.int64())
    batches = [pa.RecordBatch.from_arrays([shards[i : i + 7], texts[i : i + 7]], names=["shard", "text"]) for i in range(0, len(texts), 7)]
    want = {}
    for k, t in zip(shards.to_pylist(), texts.to_pylist()):
        want[k] = want.get(k, 0) + len((t or "").split())
    got = {}
    for b in pseudo_lm.learner(np.zeros(pseudo_lm.FINE))(iter(batches)):
        assert set(b["key"].to_pylist()) == set(range(-(-sum(int(np.prod(x)) for x in pseudo_lm.SHAPES.values()) // pseudo_lm.BLOCK)))
        got[b["shard"][0].as_py()] = b["n"][0].as_py()
    assert got == want


def test_scores_do_not_depend_on_the_split(spark, monkeypatch):
    monkeypatch.setattr(pseudo_lm, "SHARD_TOKENS", 3000)
    rng = random.Random(25)
    rows = [(i if i % 5 else None, prose(rng, rng.randrange(0, 120), 300)) for i in range(200)] + [(None, None), (3, "same"), (3, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, eight = (sorted((r.doc_id or -1, r.n_tokens, r.pll) for r in pseudo_lm.score(d).collect()) for d in (df.coalesce(1), df.repartition(8)))
    assert len(one) == len(rows) and np.allclose(one, eight, rtol=1e-4)


def test_context_helps_on_held_out_text():
    rng = random.Random(26)
    pairs = [(f"k{i}", f"v{i}") for i in range(200)]
    texts = pa.array([" ".join(w for _ in range(100) for w in rng.choice(pairs)) for _ in range(400)])
    slices = [pseudo_lm.tokens(*textops.part(*textops.utf8(texts), i, i + 20)) for i in range(0, 400, 20)]
    counts = np.bincount(np.concatenate([b for b, _ in slices[:16]]), minlength=pseudo_lm.FINE)
    vocabulary = pseudo_lm.Vocabulary(counts)
    params, n = pseudo_lm.trained(iter(slices[:16]), vocabulary)
    assert n == 320 * 200
    unigram = np.log((counts + 1) / (counts + 1).sum())
    held = slices[16:]
    assert np.mean([pseudo_lm.log_likelihoods(params, vocabulary, *s).mean() for s in held]) > np.mean([unigram[b].mean() for b, _ in held]) + 0.5


def reference_log_likelihood(p, counts, ids, classes, bounds, bucket):
    """Token by token, in plain terms."""
    mass = {}
    for k, c in enumerate(classes):
        mass[c] = mass.get(c, 0) + counts[k] + 1
    head, side = pseudo_lm.HEAD, pseudo_lm.SIDE
    per = np.array([mass[c] for c in range(head * head)]).reshape(head, head)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        for t in range(a, b):
            near = [t + d for d in (*range(-side, 0), *range(1, side + 1))]
            x = np.concatenate([p["emb"][ids[bucket[q]] if a <= q < b else pseudo_lm.VOCAB] for q in near]).astype(float)
            h = np.tanh(x @ p["w1"] + p["b1"])
            u, v = divmod(int(classes[bucket[t]]), head)
            z1 = h @ p["top"] + np.log(per.sum(axis=1) / per.sum())
            z2 = h @ p["low"][u] + np.log(per[u] / per[u].sum())
            out.append(z1[u] - np.log(np.exp(z1).sum()) + z2[v] - np.log(np.exp(z2).sum()) + np.log((counts[bucket[t]] + 1) / per[u, v]))
    return np.array(out)


def test_scores_match_a_plain_reference():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 50, pseudo_lm.FINE)
    p = {k: rng.normal(size=s).astype(np.float32) * 0.3 for k, s in pseudo_lm.SHAPES.items()}
    bucket, bounds = rng.integers(0, pseudo_lm.FINE, 40).astype(np.int32), np.array([0, 1, 1, 17, 40])
    v = pseudo_lm.Vocabulary(counts)
    assert np.allclose(pseudo_lm.log_likelihoods(p, v, bucket, bounds), reference_log_likelihood(p, counts, v.ids, v.classes, bounds, bucket), atol=1e-3)


def test_steps_follow_the_gradient():
    rng = np.random.default_rng(3)
    v = pseudo_lm.Vocabulary(rng.integers(0, 50, pseudo_lm.FINE))
    p = {k: rng.normal(size=s).astype(np.float32) * 0.3 for k, s in pseudo_lm.SHAPES.items()}
    bucket, bounds = rng.choice(rng.integers(0, pseudo_lm.FINE, 20), 60).astype(np.int32), np.array([0, 25, 60])
    mean = lambda q: pseudo_lm.log_likelihoods(q, v, bucket, bounds).mean()
    new = {k: x.copy() for k, x in p.items()}
    big = {k: np.full_like(x, 1e8) for k, x in p.items()}  # the step is then in proportion to the gradient
    pseudo_lm.step(new, big, v, pseudo_lm.contexts(v.ids[bucket], bounds, np.arange(60)), v.classes[bucket])
    for k in pseudo_lm.SHAPES:
        g = (p[k].astype(np.float64) - new[k]) * 1e4 / pseudo_lm.RATE
        assert np.count_nonzero(g), k
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 0.01
        down[k][at] -= 0.01
        assert np.isclose((mean(down) - mean(up)) / 0.02, g[at], rtol=0.1), k


def test_conditional_probabilities_sum_to_one():
    v = pseudo_lm.Vocabulary(np.random.default_rng(0).integers(0, 50, pseudo_lm.FINE))
    rng = np.random.default_rng(1)
    p = {k: rng.normal(size=s).astype(np.float32) * 0.3 for k, s in pseudo_lm.SHAPES.items()}
    n = pseudo_lm.FINE
    bucket = np.tile(np.array([3, 9, 0, 7, 1], np.int32), n)
    bucket[2::5] = np.arange(n)
    ll = pseudo_lm.log_likelihoods(p, v, bucket, np.arange(0, 5 * n + 1, 5))[2::5]
    assert abs(np.exp(ll).sum() - 1) < 1e-3


# --- 6 media ------------------------------------------------------------------------------------


def test_media_round_trip(docs, empty):
    got = media_sequences.report(docs).collect()
    want = []
    for i, t, *_ in corpus():
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        stored = media_sequences.encode(payload)
        assert media_sequences.decode(stored) == payload
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)
    assert len({(r.media_sha256, r.feature) for r in got}) == len({r.media_sha256 for r in got})
    assert media_sequences.report(empty).collect() == []


def test_sequences_stay_aligned(spark):
    html = "<p>one</p><figure><img src='media:aa' alt='alt'><figcaption>first <b>picture</b></figcaption></figure>two<script>x<y</script><img src='media:zz'><p>three<video src='http://e/v.mp4'></video>"
    media = spark.createDataFrame([("aa", "A")], "digest string, feature string")
    pages = spark.createDataFrame([(1, html), (2, None), (1, html), (3, "<p>no media")], "page_id long, html string")
    got = [r for r in media_sequences.interleave(pages, media).collect()]
    assert sorted(r.page_id for r in got) == [1, 1, 2, 3] and [r.segments for r in got if r.page_id == 2] == [[]]
    for r in (r for r in got if r.page_id == 1):
        assert [(s.pos, s.kind, s.text, s.ref, s.caption, s.media and s.media.feature) for s in r.segments] == [
            (0, "text", "one", None, None, None), (1, "media", None, "media:aa", "first picture", "A"), (2, "text", "two", None, None, None),
            (3, "media", None, "media:zz", None, None), (4, "text", "three", None, None, None), (5, "media", None, "http://e/v.mp4", None, None),
        ]


@pytest.mark.parametrize("html,want", [
    ("<figure><figcaption>first</figcaption><img src=a><img src=b></figure>x", [("a", "first"), ("b", "first"), "x"]),
    ("<figure><img src=a><figcaption>open</figure><p>rest", [("a", "open"), "rest"]),
    ("<figure><img src=a><figcaption>all <p>the rest", [("a", None), "all the rest"]),
    ("<figcaption>alone</figcaption><p>x", ["alone", "x"]),
    ("<img srcset='s.png 1x, t.png 2x'><object data='o.pdf'></object>", [("s.png", None), ("o.pdf", None)]),
    ("a<noscript><img src=n>b</noscript>c<template>d", ["a", "c", "d"]),
    ("<figure><figure><img src=a><figcaption>in</figcaption></figure><img src=b alt=z><figcaption>out</figcaption></figure>", [("a", "in"), ("b", "out")]),
    ("<style>x", []), ("", []),
])
def test_odd_pages(html, want):
    assert [x["text"] if x["kind"] == "text" else (x["ref"], x["caption"]) for x in media_sequences.parse(html)] == want


def test_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in media_sequences.page_sequences(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        want = media_sequences.parse(r.html)
        assert (got[r.page_id].n_segments, got[r.page_id].text) == (len(want), "\n".join(x["text"] for x in want if x["kind"] == "text"))


# --- 7 chats ------------------------------------------------------------------------------------


def test_snapshots_collapse(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, "user", "a"), (4, 1, "bot", None), (5, 1, "bot", "b"), (None, 0, "user", "x"), (6, 0, None, None), (3, 1, "bot", "b")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit(1), "p": F.lit(2), "n_turns": F.lit(0)})
    got = {r.conv_id: (r.n_turns, r.n_equal, r.chat) for r in chat_collapse.collapse(df).collect()}
    tag = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
    assert got == {2: (2, 2, tag("user", "a") + tag("bot", "b")), 4: (2, 1, tag("user", "a") + tag("bot", "")), 5: (1, 1, tag("bot", "b")), 6: (1, 1, tag("", ""))}
    assert chat_collapse.collapse(df.limit(0)).collect() == []


# --- 8 n-grams ----------------------------------------------------------------------------------


def jaccard_components(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower() if t is None or t.isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    head = list(range(len(sets)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                head[find(a)] = find(b)
    out = []
    for a, (i, s) in enumerate(sets):
        if not s:
            out.append((i, 0, i))
            continue
        ids = [sets[b][0] for b in range(len(sets)) if sets[b][1] and find(b) == find(a) and sets[b][0] is not None]
        out.append((i, len(s), min(ids, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,num,den,block,most", [(4, 85, 100, 4096, 4), (5, 80, 100, 4096, 4), (2, 50, 100, 4096, 1), (2, 50, 100, 3, 1)])
def test_components_of_similar_documents(spark, docs, monkeypatch, k, num, den, block, most):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "CLOSEST", most)
    monkeypatch.setattr(ngram_join, "MORE", 2)
    rng = random.Random(8)
    base = prose(rng, 60).split()
    near = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
        near.append((700 + i, " ".join(w)))
    rows = [(r[0], r[1]) for r in corpus()] + near
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    assert rows_of(ngram_join.components_of(df.withColumns({"n": F.lit(1), "ent": F.lit(2)}), k, (num, den))) == jaccard_components(rows, k, num, den)


def test_one_of_each_group_stays(docs, empty):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {0, 1, 2, 9}.issubset(ids) and 21 not in ids and ids.count(9) == 1
    assert ngram_join.components_of(empty).collect() == []


def test_sketches_name_every_close_pair():
    rng = np.random.default_rng(4)
    sets = []
    for base in (rng.integers(0, 1 << 62, 250), rng.integers(0, 1 << 62, 700)):
        for _ in range(12):
            s = base.astype(np.uint64).copy()
            s[rng.integers(0, len(s), rng.integers(0, len(s) // 6))] = rng.integers(0, 1 << 62)
            sets.append(np.unique(np.concatenate([s, rng.integers(0, 1 << 62, rng.integers(0, 20)).astype(np.uint64)])))
    n, sk = np.array([len(s) for s in sets]), [ngram_join.sketch(s).view(np.uint64) for s in sets]
    none = np.zeros(len(sets), int)
    found = {frozenset((int(a), int(b))) for i, j, _ in ngram_join.near(n, np.arange(len(sets)), none, sk, 80, 100) for a, b in zip(i, j)}
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert want <= found and len(want) > 20
    own = np.arange(len(sets)) % 2
    across = {frozenset((int(a), int(b))) for i, j, _ in ngram_join.near(n, np.arange(len(sets)), own, sk, 80, 100) for a, b in zip(i, j)}
    assert across == {x for x in found if len({own[i] for i in x}) == 2}
    got = ngram_join.closest(np.arange(len(sets)), np.arange(len(sets)), ngram_join.near(n, np.arange(len(sets)), none, sk, 80, 100), 2)
    assert np.bincount(got[0]).max() == 2 and got[3].any()


def test_one_stays_whatever_the_ids(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(None, a), (None, a), (None, a + " more"), (None, b), (3, b), (5, c), (5, d), (4, d), (None, " "), (None, " "), (None, None)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    full = sorted((r.doc_id or 0, r.text) for r in kept if r.text and r.text.strip())
    assert [i for i, _ in full] == [0, 3, 4, 5] and full[0][1] in (a, a + " more")
    assert [t for _, t in full[1:]] == [b, d, c] and len(kept) == 7


# --- 9 decontamination --------------------------------------------------------------------------


def hits(text, items):
    norm = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    w, mark, found = norm(text), set(), set()
    for item, t in items:
        x = norm(t)
        k = min(13, len(x))
        for j in range(len(x) - k + 1 if k else 0):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == x[j : j + k]:
                    mark.update(range(p, p + k))
                    found.add(str(item))
    return len(w), len(mark), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(mark) and 20 * len(mark) >= len(w)


@pytest.mark.parametrize("block", [10**6, 20])
def test_decontamination(spark, docs, monkeypatch, block):
    texts = {r[0]: r[1] for r in corpus()}
    items = [(1, texts[9][40:200]), (2, "one"), (3, None), (4, ""), (5, texts[10].upper()), (10, texts[9][40:120] + " " + texts[12][:90]), (11, "ünïcode, WÖRDS!"), (12, "document without")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SENT_BYTES", block)
    found = decontaminate.find_hits(docs.select("doc_id", "text"), bench, 13)
    assert ("Join" in found._jdf.queryExecution().executedPlan().toString()) == (block == 20)
    got = {}
    for r in found.collect():
        got[r.doc_id if r.doc_id is not None else ("none", r.text)] = (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
        raw = (r.text or "").encode()
        assert all(0 <= s.byte_from < s.byte_to <= len(raw) for s in r.spans) and sum(s.word_to - s.word_from for s in r.spans) == r.n_hit
    assert {k: v for k, v in got.items() if isinstance(k, int)} == {i: hits(t, items) for i, t in texts.items() if i is not None}
    rep = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs, bench).collect() if r.doc_id is not None}
    assert rep == {i: hits(t, items) for i, t in texts.items() if i is not None}
    nameless = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs.filter("doc_id is null and text is not null"), bench).collect()}
    assert nameless == {None: hits("a document without a number", items)}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i, t in texts.items() if i is not None and not hits(t, items)[-1]}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[3] == "" and cut[0] is None and cut[7] == "a b c"


@pytest.mark.parametrize("block", [10**6, 1])
def test_items_without_id_hit(spark, block):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "six")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two"), (None, "two three"), (7, "two three"), (None, "four"), (None, None)], "item_id long, text string")
    found = decontaminate.find_hits(docs, bench, 13, block)
    assert {r.doc_id: (r.n_hit, r["items"]) for r in found.collect()} == {1: (3, ["7", None]), 2: (1, [None]), 3: (0, [])}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[2:] for r in decontaminate.report(docs, bench).collect()}
    assert got == {1: (3, 2, sha("7"), True), 2: (1, 1, sha(""), True), 3: (0, 0, sha(""), False)}


def test_nothing_is_hit_by_an_empty_benchmark(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.report(docs, none).collect()} == {0}
    assert decontaminate.report(empty, none).collect() == []


# --- 10 mixing ----------------------------------------------------------------------------------


def water(sizes, weights, most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {**{s: most * sizes[s] for s in full}, **share}
        full |= over


def test_mixing(docs, empty):
    rows = corpus()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    aim = water(sizes, (1, 2, 3))
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and rows_of(mixing.mix_sources(docs.repartition(5))) == sorted((tuple(r) for r in got), key=repr)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(aim[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - aim[s]) <= max(size(r[1]) for r in rows if r[3] == s) / 2 + 1e-6
    assert mixing.mix_sources(empty).collect() == []
    whole = mixing.mix_documents(docs.withColumn("taken", F.lit("clash"))).collect()
    assert sorted(((r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in whole), key=repr) == sorted((tuple(r) for r in got), key=repr)
    assert sorted((r.text or "" for r in whole)) == sorted(r[1] or "" for r in rows) and all(r.taken == r.size * r.repeats and 0 <= r.repeats <= 3 for r in whole)
    assert mixing.repeat_documents(mixing.mix_documents(docs)).count() == sum(r.repeats for r in whole)
    blank = mixing.mix_sources(docs.filter("doc_id < 3")).collect()
    assert {r.taken for r in blank} == {0}
