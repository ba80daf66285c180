import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from retentia.llm import multi_index

KIND = "vec_id long, embedding array<float>, label int, first int, rank int"


def exact(rows, queries, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for q in queries:
        score = (x * x[ids == q][0]).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def searched(df, k):
    found = {}
    for r in sorted(multi_index.search(df, F.col("vec_id") % 20 == 0, k).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def test_search_reaches_its_recall_and_ranks_exactly(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "ENTRY_BLOCK", 50)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)) + rng.normal(size=(6, 16))[rng.integers(0, 6, 900)]
    x[300:600] = x[300]
    rows = [(i, [float(v) for v in np.float32(row)], 0, 0, 0) for i, row in enumerate(x)]
    want, got = exact(rows, range(0, 900, 20), 20), searched(spark.createDataFrame(rows, KIND), 20)
    assert set(want) == set(got) and all(len(v) == 20 for v in got.values())
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    assert got[300] == want[300] and got[320] == want[320]


def test_unusable_vectors_take_no_part_and_few_candidates_all_come_back(spark):
    bad = [None, [], [0.0, 0.0], [1.0, None], [math.nan, 1.0], [math.inf, 1.0], [1.0, 2.0, 3.0]]
    rows = [(20, [1.0, 0.0], 0, 0, 0), (1, [1.0, 1.0], 0, 0, 0), (2, [1.0, -1.0], 0, 0, 0), (3, [-2.0, 0.0], 0, 0, 0), (None, [1.0, 1.0], 0, 0, 0)]
    df = spark.createDataFrame([*rows, *[(40 + 20 * i, v, 0, 0, 0) for i, v in enumerate(bad)]], KIND)
    assert searched(df, 20) == {20: [(1, 1.0), (2, 1.0), (3, -2.0)]}
    assert searched(df.limit(0), 20) == {}
    assert searched(spark.createDataFrame([(0, [3.0], 0, 0, 0), (7, [2.0], 0, 0, 0)], KIND), 20) == {0: [(7, 6.0)]}


def test_queries_that_share_an_id_have_ranks_of_their_own(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4))
    rows = [(i, [float(v) for v in r], 0, 0, 0) for i, r in enumerate(x)] + [(20, [float(v) for v in x[20]], 0, 0, 0), (40, [5.0, -1.0, 0.5, 2.0], 0, 0, 0)]
    got = {}
    for r in multi_index.search(spark.createDataFrame(rows, KIND), F.col("vec_id") % 20 == 0, 6).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    vectors = np.array([np.float32(r[1]) for r in rows], float)
    ids = np.array([r[0] for r in rows])

    def ranked(q, query):
        score = (vectors * query).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:6]
        return [(n + 1, int(ids[i]), float(score[i])) for n, i in enumerate(order)]

    assert sorted(got[20]) == ranked(20, vectors[20]) and sorted(got[0]) == ranked(0, vectors[0])
    assert sorted(got[40]) == sorted(ranked(40, vectors[40]) + ranked(40, vectors[61]))


def test_cells_come_by_summed_distance():
    rng = random.Random(4)
    a, b = np.array([rng.random() for _ in range(9)]), np.array([rng.random() for _ in range(7)])
    order = multi_index.visited(a, b, np.ones((9, 7), int), 63)
    sums = [a[i] + b[j] for i, j in order]
    assert len(set(order)) == 63 and sums == sorted(sums)
    assert multi_index.visited(a, b, np.zeros((9, 7), int), 5) == []


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = prose(12)
    texts = [prose(100) + "." for _ in range(60)]
    texts += [texts[3], texts[3] + " tail", prose(80) + " token=abcdefgh12345 " + prose(20)]
    texts += [f"{prose(60)}\n{shared}" for _ in range(6)]
    texts += ["!! ".join(rng.choices(vocabulary, k=100)).upper() for _ in range(12)]
    texts += [None, "", prose(4000)]
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", len(t or ""), "given", i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_dropped long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in (*range(0, 60, 2), 70, 71)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), texts, shared


def test_stages_take_effect_and_keep_clean_documents(spark, corpus):
    folder, texts, shared = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"], name
        assert all(r.n_lines == "given" and r.n_dropped == r.doc_id for r in docs.collect()), name
        seen.append({r.doc_id: r for r in docs.collect()})
    good, lines, apart, clean = seen
    junk = set(range(69, 81))
    assert set(good) == set(range(len(texts))) - junk
    assert [shared in (lines[i].text or "") for i in range(63, 69)] == [False] * 5 + [True]
    assert all(r.n_chars == len(r.text or "") for r in lines.values())
    assert set(lines) - set(apart) == {60, 61}
    assert "abcdefgh12345" not in clean[62].text and all(clean[i].text == apart[i].text for i in apart if i != 62)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(clean) and all(r.offset + r.length <= 2048 for r in packed)


def test_run_applies_all_stages(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus[0]).collect()
    assert len({r.doc_id for r in rows}) == len(corpus[1]) - 14
