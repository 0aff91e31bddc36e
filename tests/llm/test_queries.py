import random
from collections import Counter

import pytest

import corpus_pipeline
from plinth.llm import ann, packing, queries
from tests.llm.test_operators import components_by_force, plain, words
from tests.oracle import assert_same, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, FOLDER), con, queries.ORACLE_SQL[name])


def test_pipeline_keeps_what_every_stage_keeps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, FOLDER)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids
        ids = left
    got = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in got.collect()} == ids and len(ids) > 100


def test_pipeline_leaves_no_line_twice(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = [r for r in docs.where("text is not null").select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, FOLDER).collect()}
    seen = set()
    for doc_id, text in before:
        left = []
        for line in text.split("\n"):
            if not line.strip(" \t\n\v\f\r") or line not in seen:
                left.append(line)
            seen.add(line)
        assert got[doc_id] == "\n".join(left)


def similarity(a, b):
    x, y = (Counter(zip(*(w[i:] for i in range(5)), strict=False)) for w in (a, b))
    both = sum((x & y).values())
    return both / max(1, sum(x.values()) + sum(y.values()) - both)


def test_every_stage_against_planted_cases(spark, tmp_path):
    rng = random.Random(41)
    items = [(i, " ".join(words(rng, rng.randrange(25, 40)))) for i in range(6)]
    docs, junk = [], set()
    for i in range(240):
        if i % 4 == 3:
            junk.add(i)
            docs.append((i, " ".join(rng.choice(["!!", "###", "$$$", "?!", w]) for w in words(rng, 60)) + " !!!"))
        elif i % 12 == 1 and i > 12:  # a near copy of an earlier clean text, on one line each, so that no line is whole twice
            w = plain(docs[i - 12][1])
            w[rng.randrange(len(w))] = f"edit{i}"
            docs.append((i, " ".join(w)))
        elif i % 20 == 2:
            docs.append((i, f"{' '.join(words(rng, 20))}\n{items[i % 6][1]} {' '.join(words(rng, 12))}"))
        else:
            lines = [" ".join(words(rng, rng.randrange(8, 20))) + "." for _ in range(4)]
            docs.append((i, "\n".join([*lines, "Subscribe to the letter of this page for more of it."] if i % 3 == 0 else lines)))
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0 if i in junk else 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id: r.text for r in corpus_pipeline.quality_stage(spark, now, str(tmp_path)).collect()}
    assert kept == {i: t for i, t in docs if i not in junk}
    now = corpus_pipeline.quality_stage(spark, now, str(tmp_path))
    seen, want = set(), {}
    for i in sorted(kept):
        left = []
        for line in kept[i].split("\n"):
            if line not in seen:
                left.append(line)
            seen.add(line)
        want[i] = "\n".join(left)
    now = corpus_pipeline.line_dedup_stage(spark, now, str(tmp_path))
    kept = {r.doc_id: r.text for r in now.collect()}
    assert kept == want
    comps = components_by_force(list(kept.items()))
    now = corpus_pipeline.near_copy_stage(spark, now, str(tmp_path))
    kept = {r.doc_id: r.text for r in now.collect()}
    assert set(kept) == {i for i, (_, c) in comps.items() if c == i} and len(kept) < len(comps)
    leaks = set()
    for i, t in kept.items():
        w = t.replace(".", " ").lower().split()
        for _, item in items:
            n = len(item.split())
            if any(similarity(w[s : s + n], item.lower().split()) >= 0.75 for s in range(max(1, len(w) - n + 1))):
                leaks.add(i)
    now = corpus_pipeline.decontamination_stage(spark, now, str(tmp_path))
    assert {r.doc_id for r in now.collect()} == set(kept) - leaks and leaks
    rows = corpus_pipeline.packing_stage(spark, now, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(set(kept) - leaks)
    lengths = Counter(len(plain(kept[r.doc_id])) for r in rows)
    kinds = sorted(lengths)
    tops = packing.best_boundaries(kinds, [lengths[k] for k in kinds], [k * lengths[k] for k in kinds])
    assert all(r.boundary == min(t for t in tops if t >= r.n_tokens) for r in rows)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept) - leaks


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_recall_of_the_index_on_the_embeddings(spark):
    import numpy as np

    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries.QUERIES["op9_approximate_nearest_neighbours"](spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in got:
        near = x @ x[ids == q][0]
        near[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, -near))[: ann.K]].tolist()))
    assert hits / (ann.K * len(got)) >= 0.9
