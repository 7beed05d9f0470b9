"""Candidates from one sort, sketched quantiles, level dictionaries as tables, local classifiers."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from liftlab.operators import learners, ranking
from liftlab.sources.overlay import experiment_table, rule_scores
from liftlab.spec import ExperimentSpec, ValidationError

SF = "/root/testdata/sf0.001"
SPEC = ExperimentSpec()


@pytest.fixture(scope="module")
def scored(spark):
    return rule_scores(experiment_table(spark, SF)).select("id", "treatment", "visit", "score").cache()


@pytest.mark.parametrize("partitions", [None, 7])
def test_areas_of_all_candidates_equal_single_evaluations(spark, scored, partitions):
    variants = {0: F.col("score"), 1: -F.col("score"), 2: F.lit(0.5), 3: F.sin("id")}
    long = scored.select("id", "treatment", F.col("visit").alias("outcome"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("candidate"), x.cast("double").alias("score")) for c, x in variants.items()])))
    got = {r["candidate"]: r for r in ranking.candidate_auuc(long, partitions=partitions).collect()}
    assert len(got) == 4
    for c, x in variants.items():
        ev = ranking.RankedEvaluation(scored.withColumn("score", x.cast("double")), outcome="visit")
        want = ev.auuc().first()
        ev.release()
        for k in want.asDict():
            assert got[c][k] == pytest.approx(want[k], rel=1e-12, abs=1e-9)


def test_candidates_of_different_sizes_and_bad_scores(spark, scored):
    long = scored.select("id", "treatment", F.col("visit").alias("outcome"), "score", F.lit("all").alias("candidate"))
    some = long.where("id % 3 = 0").withColumn("candidate", F.lit("some"))
    got = {r["candidate"]: r for r in ranking.candidate_auuc(long.unionByName(some)).collect()}
    ev = ranking.RankedEvaluation(scored.where("id % 3 = 0"), outcome="visit")
    assert got["some"].auuc_above_random_per_100000 == pytest.approx(ev.auuc().first()[0], rel=1e-12)
    assert got["all"].observations == scored.count()
    with pytest.raises(ValidationError, match="NaN"):
        ranking.candidate_auuc(long.withColumn("score", F.lit(float("nan"))))
    with pytest.raises(ValidationError, match="no scored rows"):
        ranking.candidate_auuc(long.limit(0))


def test_one_sort_for_all_candidates(spark, scored, monkeypatch):
    sorts = []
    kind = type(scored)
    real = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, *a: sorts.append(1) or real(self, *a))
    long = scored.select("id", "treatment", F.col("visit").alias("outcome"), "score", F.explode(
        F.sequence(F.lit(0), F.lit(5))).alias("candidate"))
    areas = {r[1] for r in ranking.candidate_auuc(long).collect()}
    assert len(sorts) == 1 and len(areas) == 1


# ---- A11

@pytest.mark.parametrize("k", [200, 4000])
def test_sketched_quantiles_keep_their_rank_error(spark, k):
    df = spark.range(200_000).select(F.sin("id").alias("score"), (F.col("id") % 2).alias("treatment"),
                                     (F.col("id") % 3 == 0).cast("int").alias("outcome"))
    got = ranking.cate_distribution(df, k=k)
    assert got.columns[-1] == "rank_error" and got.first()["rank_error"] == ranking.quantile_rank_error(k) < 0.014
    checks = ranking.quantile_ranks(df, got, tolerance=ranking.quantile_rank_error(k)).collect()
    assert [c["probability"] for c in checks] == list(ranking.CATE_QUANTILES) and all(c["within"] for c in checks)


def test_exact_parts_of_the_sketched_summary(spark, scored):
    ev = ranking.RankedEvaluation(scored, outcome="visit")
    want, got = ev.cate_summary(full_benchmark_itt=0.1).first(), ranking.cate_distribution(
        scored, outcome="visit", full_benchmark_itt=0.1).first()
    ev.release()
    for c in want.asDict():
        if "percentile" not in c and c != "median":
            assert got[c] == pytest.approx(want[c], rel=1e-12), c
    plan = ranking.cate_distribution(scored, outcome="visit")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    with pytest.raises(Exception, match="NaN"):
        ranking.cate_distribution(scored.withColumn("score", F.lit(None).cast("double")), outcome="visit").collect()


# ---- M1

def _features(model, df, spec):
    return [tuple(r[0]) for r in learners.transform_features(model, df, [spec.id]).orderBy(spec.id).select(
        vector_to_array("features")).collect()]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_level_tables_give_the_same_design(spark, monkeypatch, broadcast):
    monkeypatch.setattr(learners.LevelDictionary, "BROADCAST_LEVELS", broadcast)
    df = experiment_table(spark, SF).withColumn("f1", F.when(F.col("id") % 5 > 0, F.col("f1")))  # null levels
    train, other = df.where("id % 3 > 0"), df.where("id % 3 = 0").withColumn(
        "f4", F.when(F.col("id") % 2 == 0, F.lit("never seen")).otherwise(F.col("f4")))
    here, there = learners.fit_preprocessor(train, SPEC), learners.fit_preprocessor(train, SPEC, level_tables=True)
    for part in (train, other):
        assert _features(there, part, SPEC) == _features(here, part, SPEC)


def test_no_level_reaches_the_driver(spark, monkeypatch):
    monkeypatch.setattr(learners.LevelDictionary, "BROADCAST_LEVELS", 100)
    spec = ExperimentSpec(features=("x", "key"), continuous=("x",), categorical=("key",))
    df = spark.range(3000).select("id", F.rand(1).alias("x"), F.concat(F.lit("level "), "id").alias("key")).where(
        "id % 3 > 0").unionByName(spark.range(3000, 4000).select("id", F.rand(1).alias("x"), F.lit("hot").alias("key")))
    seen = []
    kind = type(df)
    real = kind.collect

    def collect(self):
        out = real(self)
        seen.extend(str(r) for r in out)
        return out

    monkeypatch.setattr(kind, "collect", collect)
    model = learners.fit_preprocessor(df, spec, level_tables=True)
    size = learners.design_size(learners.transform_features(model, df, ["id"])).first()
    assert size["columns"] == 1 + 2001 and size["rows"] == 3000 and size["nonzero_values"] >= 5999
    assert len(seen) < 50 and not any("level" in r or "hot" in r for r in seen)


def test_slots_of_level_tables_stay_out_of_the_schema(spark):
    # A slot's name in the column's metadata is a level's share of the driver's memory.
    spec = ExperimentSpec(features=("x", "key"), continuous=("x",), categorical=("key",))
    df = spark.range(3000).select("id", F.rand(1).alias("x"), F.col("id").cast("string").alias("key"),
                                  (F.col("id") % 2).cast("int").alias("treatment"))
    design = learners.transform_features(learners.fit_preprocessor(df, spec, level_tables=True), df, ["id", "treatment"])
    assert len(design.schema.json()) < 1000
    plan = learners.design_size(design)._jdf.queryExecution().optimizedPlan().toString()
    assert "summarizer" not in plan.lower()  # its buffers have the design's width
    both = learners.s_learner_design(design)
    assert len(both.schema.json()) < 2000
    row = both.where("id = 1").select(F.unwrap_udt("features").alias("x"), F.unwrap_udt("_design").alias("d")).first()
    (i, j), n = row.x.indices, 3001
    assert row.d.size == 2 * n + 1 and row.d.indices == [i, j, n, n + 1 + i, n + 1 + j]
    assert row.d["values"] == [*row.x["values"], 1.0, *row.x["values"]]


# ---- M16

class Rate:
    """Base rate of the fitted labels, plus a slope on the last feature."""

    def __init__(self, rate=0.0, slope=0.0):
        self.rate, self.slope, self.rows = rate, slope, 0

    def fit(self, X, y):
        self.rate, self.rows = float(np.mean(y)), len(y)

    def predict_proba(self, X):
        p = self.rate + self.slope * X[:, -1]
        return np.column_stack([1 - p, p])


class Fixed:
    def __init__(self, p):
        self.p = p

    def predict_proba(self, X):
        return np.tile([1 - self.p, self.p], (len(X), 1))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see the tests


def _table(spark, n=400):
    from pyspark.ml.feature import VectorAssembler
    raw = spark.range(n).select("id", (F.col("id") / n).alias("x"), (F.col("id") % 2).cast("int").alias("treatment"),
                                (F.col("id") % F.when(F.col("id") % 2 == 1, 4).otherwise(8) < 2).cast("int").alias("visit"))
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(raw)


def test_objects_with_predict_proba_plug_in(spark):
    df = _table(spark)
    m = learners.TLearner.fit(df, "visit", alpha=0.1, classifier=lambda a: learners.LocalClassifier(Rate))
    want = {t: df.where(F.col("treatment") == t).agg(F.avg("visit")).first()[0] for t in (0, 1)}
    rows = learners.predict_uplift(m, df).collect()
    assert {(round(r.p1, 9), round(r.p0, 9)) for r in rows} == {(round(want[1], 9), round(want[0], 9))}
    assert m.treated_model.rows == 200 and m.convergence()["treatment_iterations"] is None
    # A slope on X * T, the last entry of the S-learner's design.
    s = learners.SLearner.fit(df, "visit", alpha=0.1, classifier=lambda a: learners.LocalClassifier(lambda: Rate(slope=0.1), max_rows=50))
    assert s.model.rows == 50
    assert all(r.cate == pytest.approx(0.1 * r.x) for r in learners.predict_uplift(s, df).collect())


def test_fitted_models_plug_in_and_are_clipped(spark):
    fitted = iter([Fixed(1.0), Fixed(0.0)])
    m = learners.TLearner.fit(_table(spark, 10), "visit", alpha=0.1, classifier=lambda a: next(fitted))
    assert {(r.p1, r.p0) for r in learners.predict_uplift(m, _table(spark, 10)).collect()} == {(1 - 1e-7, 1e-7)}


def test_selection_over_outcomes_and_learners(spark):
    df = _table(spark, 300).withColumn("conversion", F.col("visit") * (F.col("id") % 4 == 1).cast("int"))
    spec = ExperimentSpec(features=("x",), continuous=("x",), categorical=())
    found = learners.choose(learners.fit_candidates([("visit", "t_learner"), ("conversion", "s_learner")], df, spec=spec, alphas=(1e-5, 10.0)), df, spec)
    for (outcome, learner), rep in found.items():
        alone = learners.select_model(learner, df, df, outcome, spec=spec, alphas=(1e-5, 10.0), parallelism=2)
        assert alone.selected_alpha == rep.selected_alpha
        assert [c["validation_auuc_above_random_per_100000"] for c in alone.candidates] == pytest.approx(
            [c["validation_auuc_above_random_per_100000"] for c in rep.candidates])
        for c in rep.candidates:
            m = learners.LEARNERS[learner].fit(df, outcome, alpha=c["alpha"])
            ev = ranking.RankedEvaluation(learners.predict_uplift(m, df), score="cate", outcome=outcome)
            assert c["validation_auuc_above_random_per_100000"] == pytest.approx(ev.auuc().first()[0], rel=1e-6, abs=1e-6)
            ev.release()
