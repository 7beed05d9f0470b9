"""Gain curve, AUUC, random line, policy table, deciles, quantiles, AUC."""

import numpy as np
import pytest

from liftlab.operators.ranking import (RankedEvaluation, curve_counts, decile_bounds,
                                       predictive_diagnostics, rank_rows)
from pyspark.sql import functions as F


def _frame(spark, scores, signal=None, outcome=None, treatment=None):
    n = len(scores)
    outcome = outcome or [0] * n
    treatment = treatment or [1] * n
    signal = signal or [0.0] * n
    rows = [(i, float(s), float(z), int(y), int(t))
            for i, (s, z, y, t) in enumerate(zip(scores, signal, outcome, treatment))]
    return spark.createDataFrame(rows, "id long, score double, signal double, outcome int, "
                                       "treatment int")


def test_gain_curve_and_auuc(spark):
    df = _frame(spark, [4, 3, -1, -2], signal=[4, 3, -1, -2])
    ev = RankedEvaluation(df, signal="signal", points=4)
    curve = ev.gain_curve().orderBy("point").collect()
    assert [r.policy_gain_per_100000 for r in curve] == pytest.approx(
        [0, 100000, 175000, 150000, 100000])
    assert ev.auuc().first().auuc_above_random_per_100000 == pytest.approx(68750)


def test_random_line_and_treat_all(spark):
    df = _frame(spark, [3, 2, 1, 0], signal=[2, 0, 1, 1])
    ev = RankedEvaluation(df, signal="signal", points=4)
    curve = ev.gain_curve().orderBy("point").collect()
    assert [r.random_gain_per_100000 for r in curve] == pytest.approx(
        [0, 25000, 50000, 75000, 100000])
    assert curve[0].treat_all_gain_per_100000 == pytest.approx(100000)


def test_policy_table_denominators(spark):
    df = _frame(spark, list(range(9, -1, -1)), signal=[2, 0, 2, 0, 2, 0, 0, 0, 0, 0],
                outcome=[1, 0, 1, 0, 1, 0, 0, 0, 0, 0], treatment=[1, 0] * 5)
    ev = RankedEvaluation(df, signal="signal", fractions=(0.5,))
    row = ev.targeting_policy().first()
    assert row.targeted_count == 5
    assert row.estimated_incremental_outcome_rate_among_targeted == pytest.approx(1.0)
    assert row.incremental_outcomes_per_100000_population == pytest.approx(50000)
    assert row.random_targeting_per_100000_population == pytest.approx(30000)
    assert row.ipw_transformed_outcome_rate_among_targeted == pytest.approx(1.2)


def test_newcombe_no_events_is_not_degenerate(spark):
    df = _frame(spark, [4, 3, 2, 1], outcome=[0, 0, 0, 0], treatment=[1, 1, 0, 0])
    ev = RankedEvaluation(df, outcome_name="conversion", fractions=(1.0,))
    row = ev.targeting_policy().first()
    assert row.observed_difference_ci_lower == pytest.approx(-0.6576197724933468, rel=1e-12)
    assert row.observed_difference_ci_upper == pytest.approx(0.6576197724933468, rel=1e-12)
    assert row.insufficient_control_events is True


def test_treat_all_equals_random(spark):
    df = _frame(spark, [4, 3, 2, 1], outcome=[1, 0, 0, 0], treatment=[1, 1, 0, 0])
    ev = RankedEvaluation(df, fractions=(1.0,))
    row = ev.targeting_policy().first()
    assert row.incremental_outcomes_per_100000_population == pytest.approx(
        row.random_targeting_per_100000_population)
    assert row.incremental_outcomes_per_100000_population == pytest.approx(0.5 * 100000)
    assert row.incremental_outcomes_above_random_per_100000 == pytest.approx(0.0)


def test_curve_counts_floating_point_rule():
    ks = [k for _, _, k in curve_counts(100)]
    # 0.07 * 100 is 7.000000000000001 in doubles, so 8 rows are targeted
    assert ks[7] == 8 and ks[14] == 15 and ks[-1] == 100


def test_decile_sizes_match_array_split():
    for n in (7, 10, 23, 101):
        sizes = [hi - lo for _, lo, hi in decile_bounds(n)]
        assert sizes == [len(a) for a in np.array_split(np.arange(n), 10)]


def test_rank_rows_matches_sorted_order_with_heavy_ties(spark):
    rng = np.random.default_rng(0)
    scores = np.where(rng.random(3000) < 0.4, 0.5, rng.random(3000)).round(3)
    rows = [(int(i), float(s)) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "id long, score double")
    ranked = rank_rows(df, [F.col("score").desc(), F.col("id").asc()], partitions=7)
    got = {r.id: r.rank for r in ranked.collect()}
    order = sorted(range(len(rows)), key=lambda i: (-scores[i], i))
    assert all(got[i] == pos + 1 for pos, i in enumerate(order))


def test_deciles_and_cate_quantiles(spark):
    rng = np.random.default_rng(1)
    n = 203
    s = rng.normal(size=n)
    y = (rng.random(n) < 0.3).astype(int)
    t = (rng.random(n) < 0.6).astype(int)
    rows = [(i, float(s[i]), 0.0, int(y[i]), int(t[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, score double, signal double, outcome int, "
                                     "treatment int")
    ev = RankedEvaluation(df)
    dec = ev.uplift_deciles().orderBy("rank").collect()
    order = np.argsort(-s, kind="mergesort")
    for d, idx in zip(dec, np.array_split(order, 10)):
        assert d.observations == len(idx)
        assert d.mean_predicted_uplift == pytest.approx(s[idx].mean())
        assert d.treatment_positive == int((y[idx] * t[idx]).sum())
    cs = ev.cate_summary(full_benchmark_itt=0.01).first()
    q = np.quantile(s, [0.05, 0.25, 0.5, 0.75, 0.95])
    assert [cs.percentile_05, cs.percentile_25, cs.median, cs.percentile_75,
            cs.percentile_95] == pytest.approx(list(q), rel=1e-12)
    assert cs.standard_deviation == pytest.approx(s.std(ddof=0))
    assert cs.proportion_positive == pytest.approx((s > 0).mean())


def _auc(y, p):
    pos = [pi for yi, pi in zip(y, p) if yi == 1]
    neg = [pi for yi, pi in zip(y, p) if yi == 0]
    tot = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return tot / (len(pos) * len(neg))


def test_predictive_diagnostics_auc_with_ties(spark):
    rng = np.random.default_rng(2)
    n = 300
    p1 = rng.integers(1, 20, n) / 20.0
    p0 = rng.integers(1, 20, n) / 20.0
    t = (rng.random(n) < 0.5).astype(int)
    y = (rng.random(n) < np.where(t == 1, p1, p0)).astype(int)
    rows = [(i, int(y[i]), int(t[i]), float(p1[i]), float(p0[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, outcome int, treatment int, p1 double, p0 double")
    out = {r.group: r for r in predictive_diagnostics(df).collect()}
    fact = np.where(t == 1, p1, p0)
    assert out["overall"].roc_auc == pytest.approx(_auc(y, fact), rel=1e-12)
    m = t == 1
    assert out["treated_p1"].roc_auc == pytest.approx(_auc(y[m], p1[m]), rel=1e-12)
    assert out["control_p0"].roc_auc == pytest.approx(_auc(y[~m], p0[~m]), rel=1e-12)
    ll = -np.mean(y * np.log(fact) + (1 - y) * np.log(1 - fact))
    assert out["overall"].log_loss == pytest.approx(ll)


def test_nan_and_null_scores_rejected(spark):
    from liftlab.spec import ValidationError
    nan = _frame(spark, [1.0, float("nan"), 0.5])
    with pytest.raises(ValidationError, match="null or NaN"):
        RankedEvaluation(nan)
    null = nan.withColumn("score", F.when(F.col("id") == 0, None).otherwise(F.lit(0.3)))
    with pytest.raises(ValidationError, match="1 scores"):
        RankedEvaluation(null)


def test_rank_spreads_a_hot_score_over_partitions(spark):
    # a third of all rows share one score: the unique id in the range key
    # must still split them across partitions, and ranks stay exact
    n = 30_000
    df = spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(
            (F.col("id") * 7919 % 1000) / 1000.0).alias("score"))
    ranked = rank_rows(df, [F.col("score").desc(), F.col("id").asc()], partitions=8)
    sizes = [r["count"] for r in ranked.groupBy(F.spark_partition_id().alias("p")).count()
             .collect()]
    assert sum(sizes) == n and len(sizes) == 8
    assert max(sizes) < 2 * n / 8
    hot = ranked.where(F.col("score") == 0.5).agg(F.min("rank"), F.max("rank"),
                                                  F.count(F.lit(1))).first()
    assert hot[2] >= n // 3 and hot[1] - hot[0] + 1 == hot[2]  # one contiguous block
