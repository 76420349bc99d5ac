"""Each stage of the pipeline on its own input, against brute force."""

import corpus_pipeline as cp

from tests.conftest import DATA
from tests.llm.test_operators import linked, removed, shingles


def test_stages(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "words of an unknown document", "en", "s", 5), (900_001, None, None, None, None)], docs.schema)
    docs = docs.unionAll(nulls)
    now = [(r.doc_id, r.text) for r in docs.collect()]
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        if k < len(cp.STAGES) - 1:
            assert out.columns == cp.COLUMNS
            out = cp.written(out, f"test-{name}")
        after = [(r.doc_id, r.text) for r in out.collect()] if k < 4 else out.collect()
        if k == 0:
            assert set(after) <= set(now) and len(after) > 0.5 * len(now)
        elif k == 1:
            comp = linked(now, 5, 80)
            assert sorted(after, key=str) == sorted((x for x in now if x[0] is None or comp[x[0]] == x[0]), key=str)
        elif k == 2:
            sizes = {i: n - gone for i, n, gone, _, _ in removed(now, cp.PASSAGE_BYTES) if i is not None}
            assert len(after) == len(now) and all(len((t or "").encode()) <= sizes[i] and len((t or "").encode()) > sizes[i] - 8 * 3 for i, t in after if i is not None)
            assert sum(t is None for _, t in after) == sum(t is None for _, t in now)
        elif k == 3:
            items = [shingles(r.text, 5) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            dirty = lambda t: any(q and len(q & shingles(t, 5)) >= 0.8 * len(q) for q in items)
            assert sorted(after, key=str) == sorted((x for x in now if not dirty(x[1])), key=str)
        else:
            assert {r.doc_id for r in after} == {i for i, _ in now}
        docs, now = out, after


def test_pipeline_on_empty_documents(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_repeats_of_fifty_short_words(spark):
    passages = [" ".join(chr(97 + (k * k + j) % 26) for k in range(50)) for j in range(2)] + [" ".join(str(k % 7 * 11 + j) for k in range(51)) for j in (10, 20)]
    rows = [(2 * j + k, f"{k}{own} {p} {own}{k}", "en", "s", 0) for j, p in enumerate(passages) for k, own in enumerate(("first", "second"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert all(len(p) < 200 and len(p.split()) >= 50 for p in passages)
    kept = {r.doc_id: r.text for r in cp.repeated_passages(spark, docs, "").collect()}
    for j, p in enumerate(passages):
        assert p in kept[2 * j] and len(kept[2 * j + 1]) < 20


def test_rows_of_one_id_are_judged_alone(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(1, f"{passage} first"), (7, f"ROW A keeps this head. {passage}"), (7, "ROW B has nothing repeated at all."), (None, f"unknown {passage}"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in cp.repeated_passages(spark, docs, "").collect()), key=str)
    want = [(1, rows[0][1]), (7, "ROW A keeps this head. "), (7, rows[2][1]), (None, "unknown"), (8, None)]  # the last space before the passage repeats too
    assert got == sorted(((i, t, len(t or "")) for i, t in want), key=str)
    out = cp.quality_filter(spark, docs, f"{DATA}/sf0.001").collect()
    assert {(r.doc_id, r.text) for r in out} <= set(rows)
