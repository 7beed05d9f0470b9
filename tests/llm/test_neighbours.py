"""One-bit codes: estimates, error bounds, and results against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftlab.llm import neighbours

SF = "/root/testdata/sf0.01"


def brute(rows, k=20, is_query=lambda i: i % 20 == 0):
    out = {}
    for i, v in rows:
        if is_query(i):
            s = sorted(((-float(np.dot(v, w)), j) for j, w in rows if j != i and len(w) == len(v)))[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


def test_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    v, q = rng.standard_normal((3000, 32)), rng.standard_normal((20, 32))
    code, length, a = neighbours.encode(v)
    d = code.shape[1] * 8
    signs = np.unpackbits(code, axis=1) * 2.0 - 1
    est = (q @ neighbours.rotation(32).T) @ signs.T / np.sqrt(d) / a * length
    gap = (est - q @ v.T) / np.outer(np.linalg.norm(q, axis=1), length)
    room = np.sqrt(1 - a ** 2) / a * neighbours.EPSILON / np.sqrt(d - 1)
    assert abs(gap.mean()) < 0.002 and (np.abs(gap) <= room).mean() > 0.995


def test_query_recall_and_scores_on_the_whole_table(spark):
    got = neighbours.query(spark, SF).toPandas()
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64))
            for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, vectors = brute(rows), dict(rows)
    hits = 0
    assert set(got.query_id) == set(want)
    for i, g in got.sort_values("rank").groupby("query_id"):
        assert g["rank"].tolist() == list(range(1, 21))
        assert i not in set(g.vec_id)
        for j, s in zip(g.vec_id, g.score):
            assert s == pytest.approx(float(np.dot(vectors[i], vectors[j])), abs=1e-12)
        hits += len(set(g.vec_id) & {j for j, _ in want[i]})
    assert hits / (20 * len(want)) >= 0.99


def test_few_vectors_are_reranked():
    rng = np.random.default_rng(2)
    v, q = rng.standard_normal((6000, 64)), rng.standard_normal((50, 64))
    s = neighbours.Search(np.arange(50), -1 - np.arange(50), q, 20)
    for a in range(0, 6000, 1000):
        s.add(np.arange(a, a + 1000), *neighbours.encode(v[a:a + 1000]), v[a:a + 1000])
    assert s.compared < 0.25 * 50 * 6000
    exact = np.argsort(-(q @ v.T), axis=1)[:, :20]
    assert np.mean([len(set(s.best[np.flatnonzero(s.number == i)[0]]) & set(exact[i])) for i in range(50)]) > 19.9


@pytest.mark.parametrize("block", [8192, 2])
def test_odd_rows(spark, block):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [2.0, 4.0]), (2, [2.0, 4.0]), (3, [-1.0, 0.5]),
            (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]),
            (None, [1.0, 1.0]), (40, [0.0, 0.0]), (60, [1.0, 2.0, 3.0]), (61, [1.0, 1.0, 1.0]), (80, [5.0]),
            (10, [1e300, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {"code": F.lit("clash"), "score": F.lit(1), "rank": F.lit(2)})
    index = neighbours.build_index(df)
    got = neighbours.search(index, index.where("vec_id % 20 = 0"), k=3, query_block=block).collect()
    lists = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        lists.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert lists[0] == [(10, 1e300), (1, 10.0), (2, 10.0)]
    assert lists[20] == [(10, 1e300), (10, 1e300), (1, 10.0), (1, 10.0), (2, 10.0), (2, 10.0)]
    assert lists[60] == [(61, 6.0)]
    assert set(lists) == {0, 20, 60}


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    index = neighbours.build_index(df)
    assert neighbours.search(index, index).count() == 0


def test_exact_setting_equals_brute_force_where_the_bound_fails(spark):
    """A bound far too narrow loses neighbours; without a bound none is lost."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(6)
    index = neighbours.build_index(df)
    score = v @ v.T
    np.fill_diagonal(score, -np.inf)
    want = {(q, r): int(i) for q in range(0, 600, 20) for r, i in enumerate(np.argsort(-score[q], kind="stable")[:5], 1)}

    def found(epsilon):
        got = neighbours.search(index, index.where("vec_id % 20 = 0"), k=5, query_block=16, epsilon=epsilon)
        return {(r["query_id"], r["rank"]): r["vec_id"] for r in got.collect()}

    assert found(None) == want
    narrow = found(-2.0)
    assert narrow != want
