"""Exact samples and stratified splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftlab.operators import sampling
from liftlab.spec import ValidationError


def _frame(spark, dup=0):
    rows = []
    i = 0
    for t in (0, 1):
        for v in (0, 1):
            for c in (0, 1):
                for r in range(10):
                    rows.append((i, t, v, c, float(r % 3)))
                    i += 1
    rows += [(i + k, *rows[k][1:]) for k in range(dup)]
    return spark.createDataFrame(rows, "id long, treatment int, visit int, conversion int, "
                                       "f0 double")


def test_split_sizes_reproducible_disjoint(spark):
    df = _frame(spark)
    a = sampling.split_rows(df, 42)
    sizes = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
    assert sizes == {"train": 48, "validation": 16, "test": 16}
    first = {r.id: r.split for r in a.collect()}
    again = {r.id: r.split for r in sampling.split_rows(df, 42).collect()}
    assert first == again and len(first) == 80
    per = a.groupBy("stratum", "split").count().collect()
    assert {(r.split, r["count"]) for r in per} == {("train", 6), ("validation", 2), ("test", 2)}


def test_split_keeps_duplicates(spark):
    df = _frame(spark, dup=5)
    out = sampling.split_rows(df, 7)
    assert out.count() == 85
    cols = ["treatment", "visit", "conversion", "f0"]
    assert out.count() - out.select(cols).distinct().count() == df.count() - df.select(
        cols).distinct().count()


def test_small_stratum_rejected(spark):
    df = _frame(spark).where(~((F.col("treatment") == 1) & (F.col("visit") == 1)
                               & (F.col("conversion") == 1) & (F.col("id") % 10 > 2)))
    with pytest.raises(ValidationError):
        sampling.split_rows(df, 42)


def test_sample_exact_and_deterministic(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "id")
    s1 = sampling.sample_rows(df, 1234, 42)
    assert s1.count() == 1234
    assert sorted(r.id for r in s1.collect()) == sorted(
        r.id for r in sampling.sample_rows(df.repartition(7), 1234, 42).collect())
    assert sampling.sample_rows(df, 10_000, 1).count() == 5000  # clamped
    with pytest.raises(ValidationError):
        sampling.sample_rows(df, 10_000, 1, on_oversize="error")


def _selected(spark, ids, n, seed):
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    return {r.id for r in sampling.sample_rows(df, n, seed).collect()}


def test_samples_are_random_over_consecutive_ids(spark):
    n, total, block = 40_000, 100_000, 500
    df = spark.range(total)
    mask = np.zeros(total)
    mask[[r.id for r in sampling.sample_rows(df, n, 42).collect()]] = 1
    share = n / total
    counts = mask.reshape(-1, block).sum(axis=1)
    # Block counts vary as draws without replacement do (200 blocks: +-25% is 2.5 sd).
    assert 0.7 < counts.var() / (block * share * (1 - share)) < 1.35
    centred = mask - share
    for lag in range(1, 40):
        corr = (centred[:-lag] * centred[lag:]).mean() / (share * (1 - share))
        assert abs(corr) < 0.02, (lag, corr)


def test_seeds_give_unrelated_samples(spark):
    ids = range(20_000)
    a = _selected(spark, ids, 5_000, 42)
    for seed in (43, 44, 42 + 1_000_003):
        b = _selected(spark, ids, 5_000, seed)
        assert abs(len(a & b) - 1250) < 130  # 4.9 sd of the overlap of independent draws
        for shift in (1, 1_000_003):
            assert len({i + shift for i in a} & b) < 1400


def test_ids_of_any_size_sign_and_type(spark):
    ids = [-50_000_000 + 1000 * i for i in range(50_000)] + [1000 * i for i in range(50_000)]
    got = _selected(spark, ids, 10_000, 0)
    assert abs(sum(i < 0 for i in got) - 5000) < 250
    big = [i for i in range(5000)] + [i + (1 << 32) for i in range(5000)]
    got = _selected(spark, big, 4000, 1)
    both = sum((i + (1 << 32)) in got for i in got)
    assert abs(both - 800) < 130  # equal modulo 2**32 is nothing special
    df = spark.range(3000).selectExpr("concat('u', id) as id")
    assert sampling.sample_rows(df, 700, 5).distinct().count() == 700


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None,)] + [(i,) for i in range(999)], "id long")
    for n in (1, 500, 999):
        assert sampling.sample_rows(df, n, 3).count() == n
    same = spark.createDataFrame([(7,)] * 100, "id long")
    with pytest.raises(ValidationError, match="unique ids"):
        sampling.sample_rows(same, 50, 3)
    with pytest.raises(Exception, match="unique ids"):
        sampling.split_rows(same.withColumn("s", F.lit(0)), 1, stratum=F.col("s")).collect()


def test_buckets_change_nothing(spark, monkeypatch):
    df = spark.range(4000).selectExpr("id", "cast(id % 3 as int) as s")
    def both():
        return ({r.id for r in sampling.sample_rows(df, 1500, 9).collect()},
                {r.id: r.split for r in sampling.split_rows(df, 9, stratum=F.col("s")).collect()})
    coarse = both()
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 4)
    assert both() == coarse


def test_many_strata_are_sized_without_the_driver(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "cast(id * 7 % 101 as int) as s")
    want = {r.id: r.split for r in sampling.split_rows(df, 4, stratum=F.col("s")).collect()}
    monkeypatch.setattr(sampling, "DRIVER_STRATA", 3)
    assert {r.id: r.split for r in sampling.split_rows(df, 4, stratum=F.col("s")).collect()} == want
    assert sorted(map(list(want.values()).count, ("test", "train", "validation"))) == [600, 600, 1800]


def test_null_strata_are_refused(spark):
    df = _frame(spark).withColumn("treatment", F.expr("if(id = 3, null, treatment)"))
    with pytest.raises(ValidationError, match="null"):
        sampling.split_rows(df, 1)


def test_no_shuffle_of_feature_columns(spark, tmp_path):
    _frame(spark).withColumn("payload", F.lit("x" * 50)).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for out in (sampling.split_rows(df, 1), sampling.sample_rows(df, 10, 1)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        before = plan.split("BroadcastExchange")[0] if "BroadcastExchange" in plan else plan
        assert "Exchange hashpartitioning" not in before and "rangepartitioning" not in plan


def test_small_table_keeps_rows(spark):
    from liftlab.session import small_table
    assert small_table(spark.range(10)).count() == 10
