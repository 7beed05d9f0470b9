"""Counts of cluster size, refused assignments, unique ids, plan shape of the checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftlab.operators import balance, effects, learners, population, ranking, validate
from liftlab.plans.experiment import analyze_experiment
from liftlab.spec import ExperimentSpec, ValidationError

SPEC = ExperimentSpec()


def newcombe(tp, tn, cp, cn, z):
    def wilson(x, n):
        c, h = (x + z * z / 2) / (n + z * z), z * math.sqrt(x * (n - x) / n + z * z / 4) / (n + z * z)
        return c - h, c + h
    p1, p0 = tp / tn, cp / cn
    (l1, u1), (l0, u0) = wilson(tp, tn), wilson(cp, cn)
    d = p1 - p0
    return d, d - math.hypot(p1 - l1, u0 - p0), d + math.hypot(u1 - p1, p0 - l0)


@pytest.mark.parametrize("counts", [(4 * 10**9, 9 * 10**9, 10**9, 5 * 10**9),
                                    (10**11, 3 * 10**11, 7 * 10**10, 2 * 10**11), (3, 10, 1, 4)])
def test_newcombe_beyond_bigint_products(spark, counts):
    df = spark.createDataFrame([counts], "tp long, tn long, cp long, cn long")
    cols = effects.newcombe_columns(*[F.col(c) for c in ("tp", "tn", "cp", "cn")])
    r = df.select(*[c.alias(k) for k, c in cols.items()]).first()
    want = newcombe(*counts, 1.959963984540054)
    got = (r.observed_difference, r.observed_difference_ci_lower, r.observed_difference_ci_upper)
    assert got == pytest.approx(want, rel=1e-9)


def test_auc_pairs_beyond_bigint(spark):
    big = 10**11
    ties = spark.createDataFrame([(0.1, big, 3 * big, 0), (0.2, 2 * big, big, 3 * big)],
                                 "p double, pos long, neg long, below long")
    r = ties.agg(ranking._wins2("pos", "neg", "below").alias("w"), F.sum("pos").alias("n1"),
                 F.sum("neg").alias("n0")).select(
        ranking._auc(F.col("w"), F.col("n1"), F.col("n0")).alias("auc")).first()
    # 0.1: ties with 3; 0.2: beats 3 and ties with 1.
    assert r.auc == pytest.approx((1 * 1.5 + 2 * 3.5) / (3 * 4))


def test_auc_and_log_loss_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.random() < 0.7), int(rng.random() < 0.3), float(rng.integers(1, 9) / 10),
             float(rng.integers(1, 9) / 10)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, treatment int, outcome int, p1 double, p0 double")
    got = {r["group"]: r for r in ranking.predictive_diagnostics(df).collect()}

    def auc(y, p):
        pos, neg = p[y == 1], p[y == 0]
        return np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))

    t, y, p1, p0 = (np.array([r[i] for r in rows]) for i in (1, 2, 3, 4))
    p = np.where(t == 1, p1, p0)
    for g, m in (("overall", t >= 0), ("treated_p1", t == 1), ("control_p0", t == 0)):
        loss = -np.mean(y[m] * np.log(p[m]) + (1 - y[m]) * np.log(1 - p[m]))
        assert got[g].roc_auc == pytest.approx(auc(y[m], p[m])) and got[g].log_loss == pytest.approx(loss)
        assert got[g].observations == m.sum() and got[g].positive == y[m].sum()
    per = {r["g"]: r.roc_auc for r in ranking.rank_auc(
        df.withColumn("g", F.col("id") % 3), "p1", "outcome", "g").collect()}
    ids = np.arange(400)
    for g, v in per.items():
        assert v == pytest.approx(auc(y[ids % 3 == g], p1[ids % 3 == g]))
    one = df.where("outcome = 1")
    assert {r.roc_auc for r in ranking.predictive_diagnostics(one).collect()} == {None}


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, treatment int, visit int, conversion int, exposure int")


@pytest.mark.parametrize("bad", [None, 2, -1])
def test_null_and_other_assignments_are_refused(spark, bad):
    rows = [(i, i % 2, 1, 0, 0) for i in range(8)] + [(9, bad, 1, 0, 0)]
    df = table(spark, rows)
    for fn in (population.population_summary, population.outcome_descriptives, effects.itt_effects,
               effects.allocation_audit):
        with pytest.raises(Exception, match="assignment must be 0 or 1"):
            fn(df, SPEC).collect()
    where = population.invalid_assignment(df, SPEC).first()
    assert (where.treatment_missing, where.treatment_invalid) == ((1, 0) if bad is None else (0, 1))
    # Segments without such rows are unaffected by the check itself.
    ok = population.population_summary(df.where("id < 9"), SPEC).first()
    assert (ok.treatment_count, ok.control_count, ok.visit_control) == (4, 4, 4)


def test_ranking_refuses_repeated_and_null_ids(spark):
    rows = [(i % 50, 0.5, 1, 1) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, score double, outcome int, treatment int")
    with pytest.raises(ValidationError, match="50 ids repeat"):
        ranking.RankedEvaluation(df)
    nulls = df.limit(1).withColumn("id", F.lit(None).cast("long")).unionByName(df.where("id = 1").limit(1))
    with pytest.raises(ValidationError, match="1 are null"):
        ranking.RankedEvaluation(nulls)


def test_prefix_sums(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), int(n)) for x, n in zip(rng.permutation(500), rng.integers(0, 10, 500))]
    got = ranking.prefix_sums(spark.createDataFrame(rows, "x double, n long"), ["x"], {"before": "n"})[0].collect()
    running = 0
    for r in sorted(got, key=lambda r: r.x):
        assert r.before == running
        running += r.n


def test_duplicates_by_hash_agree_with_full_rows(spark):
    nan = float("nan")
    rows = [(1.0, "a", None), (1.0, "a", None), (0.0, "a", 0), (-0.0, "a", 0), (nan, None, 1), (nan, None, 1), (None, "", None),
            (None, "", 0), (2.0, "b", 5)]
    df = spark.createDataFrame(rows, "x double, s string, n int")
    r = validate.duplicate_rows(df).first()
    assert (r.row_count, r.distinct_rows, r.duplicate_full_rows) == (9, df.distinct().count(), 9 - df.distinct().count())
    r = validate.duplicate_rows(df.limit(0)).first()
    assert (r.row_count, r.distinct_rows, r.duplicate_full_rows) == (0, 0, 0)


def test_level_table_of_any_size_and_no_hot_feature(spark):
    n = 120_000
    df = spark.range(n).selectExpr(
        "id", "cast(id % 2 as int) as treatment", "cast(id % 3 = 0 as int) as visit", "0 as conversion",
        "0 as exposure", "cast(id as double) as x", "id as code")
    spec = ExperimentSpec(features=("x", "code"), continuous=("x",), categorical=("code",))
    rep = analyze_experiment(df, spec, predictability_sample_size=None)
    assert rep["categorical_levels"].count() == n
    assert rep["categorical_balance"].first().level_count == n
    assert {"maximum_level_treatment_proportion", "maximum_level_standardized_difference"} <= set(
        rep["categorical_balance"].columns)
    rep["categorical_levels"].unpersist()


def test_segment_totals_match_level_sums(spark):
    df = spark.range(3000).selectExpr(
        "id", "cast(id % 11 < 6 as int) as treatment", "if(id % 5 = 0, null, cast(id % 7 as string)) as a",
        "cast(id % 3 as string) as b", "if(id % 4 = 0, null, 's') as seg")
    spec = ExperimentSpec(features=("a", "b"), continuous=(), categorical=("a", "b"))
    rows = balance.categorical_level_balance(df, spec, by=["seg"]).collect()
    sums = {}
    for r in rows:
        k = (r.seg, r.feature)
        a, b, w = sums.get(k, (0.0, 0.0, 0.0))
        sums[k] = (a + r.treatment_proportion, b + r.control_proportion, w + r.pooled_weight)
    assert len(sums) == 4 and all(v == pytest.approx((1, 1, 1)) for v in sums.values())


def test_design_size_counts_sparse_entries(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.sparse(5, [0, 3], [1.0, 2.0]),), (Vectors.dense([0, 1, 0, 0, 4.0]),),
                                (Vectors.sparse(5, [], []),)], ["features"])
    r = learners.design_size(df).first()
    assert (r.rows, r["columns"], r.nonzero_values) == (3, 5, 4)


def test_equivalence_reads_each_side_once(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "cast(id as double) as f0", "cast(id % 2 as int) as treatment",
                                     "0 as exposure", "0 as visit", "0 as conversion")
    spec = ExperimentSpec(features=("f0",), continuous=("f0",), categorical=())
    df.write.parquet(f"{tmp_path}/a")
    a = spark.read.parquet(f"{tmp_path}/a")
    out = validate.table_equivalence(a, validate.narrow_binaries(a, spec), spec)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan  # both aggregates are already one-row tables
    assert all(r.passed for r in out.collect())
    changed = a.withColumn("f0", F.col("f0") + F.when(F.col("id") == 7, 1).otherwise(0))
    failed = {r.check_name for r in validate.table_equivalence(a, changed, spec).collect() if not r.passed}
    assert failed == {"feature_statistics"}


def test_model_selection_reports_convergence(spark):
    rep = learners.ModelReport("t_learner", "visit", 1e-4, 1.0, [
        {"alpha": 1e-4, "validation_auuc_above_random_per_100000": 1.0, "fit_seconds": 0.1,
         "convergence": {"treatment_iterations": 5, "control_iterations": 20, "maximum_iterations": 20,
                         "treatment_reached_iteration_limit": False, "control_reached_iteration_limit": True}}])
    r = learners.candidates_frame(spark, [rep]).first()
    assert r.reached_iteration_limit and r.control_iterations == 20 and r.iterations is None and r.selected


def test_release_deletes_the_rank(spark):
    import os
    df = spark.range(100).selectExpr("id", "cast(id as double) as score", "0 as outcome", "cast(id % 2 as int) as treatment")
    ev = ranking.RankedEvaluation(df)
    path = ev._checkpoint._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(path) and ev.auuc().count() == 1
    ev.release()
    assert not os.path.exists(path)
