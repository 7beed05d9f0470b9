"""Preprocessing, S/T-learners and the train-only fit."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from liftlab.operators import learners
from liftlab.spec import ExperimentSpec


def test_s_learner_design_layout(spark):
    raw = spark.createDataFrame([(1.0, 2.0, 1), (2.0, 0.0, 0)], "x1 double, x2 double, treatment int")
    df = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(raw)
    got = [r[0] for r in learners.s_learner_design(df).select(
        vector_to_array("_design")).collect()]
    assert got == [[1.0, 2.0, 1.0, 1.0, 2.0], [2.0, 0.0, 0.0, 0.0, 0.0]]
    ones = [r[0] for r in learners.s_learner_design(df, F.lit(1.0), "_d").select(
        vector_to_array("_d")).collect()]
    assert ones[1] == [2.0, 0.0, 1.0, 2.0, 0.0]


def test_unseen_level_encodes_to_zero_and_is_not_learned(spark):
    spec = ExperimentSpec(continuous=("f0",), categorical=("f1",), features=("f0", "f1"))
    train = spark.createDataFrame([(float(i), str(i % 3)) for i in range(40)], "f0 double, f1 string")
    score = spark.createDataFrame([(1.0, "99"), (2.0, "1")], "f0 double, f1 string")
    model = learners.fit_preprocessor(train, spec)
    out = learners.transform_features(model, score, ["f1"]).collect()
    assert len(out) == 2
    unseen = [r for r in out if r.f1 == "99"][0].features.toArray()
    # 3 training levels keep 3 slots; the unseen bucket is the dropped one
    assert len(unseen) == 1 + 3 and list(unseen[1:]) == [0.0, 0.0, 0.0]
    known = [r for r in out if r.f1 == "1"][0].features.toArray()
    assert sorted(known[1:]) == [0.0, 0.0, 1.0]


def test_t_learner_recovers_cell_rates(spark):
    rows = []
    for level, (r1, r0) in {"a": (0.3, 0.1), "b": (0.2, 0.2), "c": (0.5, 0.25)}.items():
        for t, r in ((1, r1), (0, r0)):
            for i in range(200):
                rows.append((len(rows), level, t, 1 if i < r * 200 else 0))
    df = spark.createDataFrame(rows, "id long, f4 string, treatment int, visit int")
    spec = ExperimentSpec(continuous=(), categorical=("f4",), features=("f4",))
    X = learners.transform_features(learners.fit_preprocessor(df, spec), df,
                                    ["id", "f4", "treatment", "visit"])
    m = learners.TLearner.fit(X, "visit", alpha=1e-10, max_iterations=300,
                              classifier=lambda a: learners.logistic(a, 300, 1e-12))
    got = {r.f4: (r.p1, r.p0) for r in m.predict(X).groupBy("f4").agg(
        F.first("p1").alias("p1"), F.first("p0").alias("p0")).collect()}
    assert got["a"] == pytest.approx((0.3, 0.1), abs=1e-5)
    assert got["c"] == pytest.approx((0.5, 0.25), abs=1e-5)


def test_s_learner_predicts_both_arms(spark):
    rows = [(i, "a" if i % 2 else "b", i % 3 == 0 and 1 or 0, 1 if i % 5 == 0 else 0)
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, f4 string, treatment int, visit int")
    spec = ExperimentSpec(continuous=(), categorical=("f4",), features=("f4",))
    X = learners.transform_features(learners.fit_preprocessor(df, spec), df,
                                    ["id", "treatment", "visit"])
    m = learners.SLearner.fit(X, "visit", alpha=1e-4)
    out = learners.predict_uplift(m, X).collect()
    assert all(1e-7 <= r.p1 <= 1 - 1e-7 and r.cate == pytest.approx(r.p1 - r.p0) for r in out)
    assert m.convergence()["maximum_iterations"] == learners.DEFAULT_MAX_ITERATIONS


# ---- plug point (M16): stub classifiers with known probabilities ---------------------

from pyspark.ml import Estimator, Model  # noqa: E402
from pyspark.ml.functions import array_to_vector  # noqa: E402
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasPredictionCol,  # noqa: E402
                                     HasProbabilityCol, HasRawPredictionCol)


class _StubModel(Model, HasFeaturesCol, HasProbabilityCol, HasRawPredictionCol,
                 HasPredictionCol):
    """P(y=1) = base + slope * (sum of the features from index ``start``)."""

    def __init__(self, base=0.0, slope=0.0, start=0, weights=None):
        super().__init__()
        self.base, self.slope, self.start, self.weights = base, slope, start, weights

    def copy(self, extra=None):
        that = _StubModel(self.base, self.slope, self.start, self.weights)
        return self._copyValues(that, extra)

    def _transform(self, df):
        x = vector_to_array(F.col(self.getFeaturesCol()))
        p = F.lit(self.base)
        for i, w in enumerate(self.weights or []):
            p = p + F.lit(w) * x[i]
        p = p + F.lit(self.slope) * F.aggregate(
            F.slice(x, self.start + 1, 1000), F.lit(0.0), lambda a, v: a + v)
        return (df.withColumn(self.getProbabilityCol(), array_to_vector(F.array(1 - p, p)))
                .withColumn(self.getRawPredictionCol(), array_to_vector(F.array(-p, p)))
                .withColumn(self.getPredictionCol(), (p > 0.5).cast("double")))


class _StubEstimator(Estimator, HasFeaturesCol, HasLabelCol):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def copy(self, extra=None):
        return self._copyValues(_StubEstimator(self.make), extra)

    def _fit(self, df):
        return self.make(df)


def _features(spark):
    raw = spark.createDataFrame([(0, 1.0, 2.0, 1, 1), (1, 2.0, 0.0, 0, 0)],
                                "id long, x1 double, x2 double, treatment int, visit int")
    return VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(raw)


def test_s_learner_with_stub_classifier(spark):
    # design [x1, x2, T, x1*T, x2*T]: p = 0.2 + 0.1*T + 0.05*sum(X*T)
    stub = _StubEstimator(lambda df: _StubModel(0.2, 0.05, 3, weights=[0, 0, 0.1]))
    X = _features(spark)
    m = learners.SLearner.fit(X, "visit", alpha=1e-4, classifier=lambda a: stub)
    got = {r.id: r for r in learners.predict_uplift(m, X).collect()}
    assert [got[0].p0, got[1].p0] == pytest.approx([0.2, 0.2])
    assert [got[0].cate, got[1].cate] == pytest.approx([0.25, 0.20])
    assert m.convergence()["iterations"] is None


def test_t_learner_with_stub_classifiers(spark):
    fitted = iter([_StubModel(0.4), _StubModel(0.1)])  # treated model first, then control
    stub = _StubEstimator(lambda df: next(fitted))
    X = _features(spark)
    m = learners.TLearner.fit(X, "visit", alpha=1e-4, classifier=lambda a: stub)
    assert [r.cate for r in learners.predict_uplift(m, X).collect()] == pytest.approx([0.3, 0.3])
