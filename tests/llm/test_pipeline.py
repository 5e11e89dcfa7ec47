"""The pipeline, stage by stage, against brute force on a small corpus."""

import random
import re

import pytest

import corpus_pipeline

from .test_operators import SCHEMA, corpus, hits, jaccard_components, lines_kept, prose, water


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = list({r[0]: r for r in corpus() if r[0] is not None}.values())
    for i in range(300, 380):
        text = "\n".join(prose(rng, 40, 3000) for _ in range(3)) if i % 4 else "\n".join(" | ".join(w.upper() for w in prose(rng, 9).split()) for _ in range(3))
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    passage = rows[-1][1].split("\n")[0]
    rows.append((400, passage + " " + prose(rng, 20, 3000), "en", "src1", 1))
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300, 380)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, rows[12][1]), (2, rows[-2][1]), (3, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, folder).toArrow())
        rows = docs.collect()
        seen.append(name)
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            ids = {r.doc_id for r in rows}
            assert all((i in ids) == (i % 4 != 0) for i in range(300, 380))
        elif k == 1:
            want = {i: None if v is None else "\n".join(v) for i, v in lines_kept(before).items() if v is None or v}
            assert {r.doc_id: r.text for r in rows} == want
            assert all(r.text is None or r.n_chars is None or r.n_chars == len(r.text) or r.text == dict((x[0], x[1]) for x in before)[r.doc_id] for r in rows)
        elif k == 2:
            found = jaccard_components([x[:2] for x in before], 5, 80, 100)
            assert sorted(r.doc_id for r in rows) == sorted(i for i, n, c in found if n == 0 or i == c)
        elif k == 3:
            assert sorted(r.doc_id for r in rows) == sorted(i for i, t, _ in before if not hits(t, items)[-1])
        else:
            sizes = {}
            for r in rows:
                sizes[r.source] = sizes.get(r.source, 0) + r.size
            aim = water(sizes, (1, 2, 3))
            assert len(rows) == len(before) and all(r.target == pytest.approx(aim[r.source]) and r.taken <= 3 * r.size for r in rows)
    assert seen == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing"]


def test_run_is_all_stages(spark, folder):
    """Every stage by brute force, but for the classifier's verdicts, which are taken from its own test."""
    got = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    good = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, folder).collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good]
    source = {i: s for i, _, s in rows}
    rows = [(i, None if v is None else "\n".join(v)) for i, v in lines_kept(rows).items() if v is None or v]
    rows = [(i, t) for (i, t), (_, n, c) in zip(sorted(rows), sorted(jaccard_components(rows, 5, 80, 100))) if n == 0 or i == c]
    want = {i: t for i, t in rows if not hits(t, items)[-1]}
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want) > 20
    size = {i: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in want.items()}
    sizes = {}
    for i, n in size.items():
        sizes[source[i]] = sizes.get(source[i], 0) + n
    aim = water(sizes, (1, 2, 3))
    assert all(r.size == size[r.doc_id] and r.target == pytest.approx(aim[r.source]) and r.taken == r.size * r.repeats and 0 <= r.repeats <= 3 for r in got)
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - aim[s]) <= max(size[i] for i in size if source[i] == s) / 2 + 1e-6
    assert corpus_pipeline.ORACLE_SQL is None
