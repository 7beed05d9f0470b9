"""Whitening against a plain eigendecomposition of all rows, and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftlab.llm import whitening

SF = "/root/testdata/sf0.01"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def check(got, rows, k=8):
    """``rows``: (vec_id, vector). Components are free in sign."""
    kept = [(i, [math.floor(1024 * float(c)) + 100000 for c in v]) for i, v in rows if usable(v)]
    by_dim = {}
    for i, x in kept:
        by_dim.setdefault(len(x), []).append((i, x))
    got = got.toPandas()
    assert list(got.columns) == COLUMNS
    assert len(got) == sum(len(v) * min(k, d) for d, v in by_dim.items())
    for dim, members in by_dim.items():
        if not dim:
            continue
        n, ids = len(members), [i for i, _ in members]
        sums = [sum(x[j] for _, x in members) for j in range(dim)]
        dev = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in members}
        x = np.array([x for _, x in members], np.float64)
        z = x - x.mean(axis=0)
        v = z.T @ z / n
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        for c in range(min(k, dim)):
            g = got[(got.component == c + 1) & got.vec_id.isin(ids)].set_index("vec_id").loc[ids]
            assert (g.n == n).all() and [dev[i] for i in ids] == g.deviation.tolist()
            assert g.explained.to_numpy() == pytest.approx(e[c] / np.trace(v), rel=1e-9)
            assert g.identity_error.nunique() == 1 and g.identity_error.iloc[0] <= 1e-4
            want = z @ u[:, c] / math.sqrt(e[c])
            w = g.whitened.to_numpy()
            assert w * np.sign(w @ want) == pytest.approx(want, abs=1e-7)


def test_embeddings(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = whitening.query(spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    check(got, rows)


def vectors(n=400, dim=5, seed=3):
    """A third of all rows hold one vector; others differ only below the quantum."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)) * np.arange(1, dim + 1)
    base[::3] = base[0]
    base[1::7] = base[1] + rng.random((len(base[1::7]), dim)) * 1e-9
    return [(i, v.tolist()) for i, v in enumerate(base)]


@pytest.mark.parametrize("hot_share", [1024, 2, 1])
def test_copies_count_and_hot_vectors_are_joined_alike(spark, monkeypatch, hot_share):
    monkeypatch.setattr(whitening, "HOT_SHARE", hot_share)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    check(whitening.whitened_rows(df), rows)


def test_weights_of_one_fit_the_distinct_vectors(spark):
    rows = vectors(60)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whitened_rows(df, weights="one").toPandas()
    x = {tuple(math.floor(1024 * c) + 100000 for c in v) for _, v in rows}
    z = np.array(sorted(x), float)
    z -= z.mean(axis=0)
    e = np.linalg.eigvalsh(z.T @ z / len(x))[::-1]
    assert set(got.n) == {len(x)} and len(got) == 5 * len(rows)
    assert got.groupby("component").explained.first().tolist() == pytest.approx((e / e.sum()).tolist())
    assert got.identity_error.max() < 1e-9
    with pytest.raises(ValueError):
        whitening.whitened_rows(df, weights="two")


def test_each_distinct_vector_is_whitened_once(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>")
    rows = df.select("vec_id", whitening.quantised(F.col("embedding")).alias("x"))
    distinct = whitening.distinct_vectors(rows)
    done, _ = whitening.whiten(distinct, whitening.fit(distinct), 8, "counts")
    assert done.count() == rows.select("x").distinct().count() < 300
    assert done.agg(F.sum("count")).first()[0] == 400


def test_rank_and_overflow(spark):
    # Two of three dimensions vary, one is constant.
    rng = np.random.default_rng(0)
    rows = [(i, [float(a), float(b), 7.0]) for i, (a, b) in enumerate(rng.normal(size=(50, 2)))]
    got = whitening.whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    last = got[got.component == 3]
    assert last.whitened.isna().all() and (last.explained.abs() < 1e-12).all() and got.identity_error.max() < 1e-9
    one = whitening.whitened_rows(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    far = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.5, 3.0]), (4, [3e6, 1.0])]
    got = whitening.whitened_rows(spark.createDataFrame(far, "vec_id long, embedding array<float>")).toPandas()
    assert got.deviation.isna().tolist().count(True) == 8 and len(got) == 8
    near = [(i, [x]) for i, x in enumerate([0.0, 1.0, 1e5, 2e5])]
    check(whitening.whitened_rows(spark.createDataFrame(near, "vec_id long, embedding array<double>")), near)


def test_deviation_is_exact_near_the_end_of_a_long():
    for top in (3037000499, 3037000500, 3037000501):  # squares below and above 2^63
        got = whitening._deviations(np.array([[top]], np.int64), 1, [0]).to_pylist()
        assert got == [top * top if top * top < 1 << 63 else None]


def test_odd_rows(spark):
    rows = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0, 2.0]),
            (7, [1.5, 2.0]), (8, [-0.0, -3.0]), (9, [0.0, 4.0]), (10, [1.0]), (11, [2.0]), (12, [9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {n: F.lit(1) for n in ("x", "hash", "dim", "n", "component", "count", "hot")})
    check(whitening.whitened_rows(df), rows)
    check(whitening.whitened_rows(df.repartition(5)), rows)
    again = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [4.0, 4.0])],
                                  "vec_id long, embedding array<double>")
    got = whitening.whitened_rows(again).toPandas()
    assert len(got) == 10 and got.vec_id.isna().sum() == 4 and set(got.n) == {5}
    assert whitening.whitened_rows(df.limit(0)).collect() == []
    assert whitening.whitened_rows(df.where("vec_id < 5")).collect() == []
