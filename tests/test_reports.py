"""Experiment and uplift reports end to end on the sf0.001 overlay."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from liftlab.operators import learners, sampling
from liftlab.plans import uplift
from liftlab.plans.experiment import analyze_experiment
from liftlab.plans.uplift import analyze_uplift
from liftlab.sources.overlay import experiment_table
from liftlab.spec import ExperimentSpec

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return experiment_table(spark, SF).cache()


def test_experiment_report_is_consistent(table):
    rep = analyze_experiment(table, ExperimentSpec(), predictability_sample_size=500)
    pop = rep["population"].first()
    assert pop.total_count == table.count() == 1473  # FIXTURES section 3
    assert pop.treatment_count == 1251
    eff = {r.outcome: r for r in rep["itt_effects"].collect()}
    assert set(eff) == {"visit", "conversion"}
    v = eff["visit"]
    assert v.absolute_risk_difference == pytest.approx(
        v.treatment_rate - v.control_rate, abs=1e-12)
    assert v.absolute_risk_difference_ci_lower < v.absolute_risk_difference \
        < v.absolute_risk_difference_ci_upper
    assert rep["categorical_balance"].count() == 8 and rep["continuous_balance"].count() == 4
    assert rep["mde"].count() == 4
    pred = rep["treatment_predictability"].first()
    assert pred.training_observations == 500  # the bound on rows to fit
    assert pred.test_observations == 369  # every held-out row: ceil(1473 / 4)


MANY = 280_000  # units, of which 210,000 train


def _baseline(treated: int, control: int) -> tuple[int, int, float]:
    """Training rows, test rows and base-rate log loss of the 75/25 split by arm."""
    sizes = sampling.split_sizes({1: treated, 0: control}, 0.25, 1.0)
    train, test = (sum(s[i] for s in sizes.values()) for i in (0, 2))
    base = sizes[1][0] / train
    return train, test, -(sizes[1][2] * math.log(base) + sizes[0][2] * math.log(1 - base)) / test


def test_predictability_fits_on_every_training_row(spark):
    df = spark.range(MANY).selectExpr(
        "id", "cast(id % 5 < 4 as int) as treatment", "cast(id % 3 = 0 as int) as visit", "0 as conversion", "0 as exposure",
        "cast(id % 101 as double) as x", "cast(id % 7 as string) as level")
    spec = ExperimentSpec(features=("x", "level"), continuous=("x",), categorical=("level",))
    rep = analyze_experiment(df, spec)
    rep["categorical_levels"].unpersist()
    got = rep["treatment_predictability"].first()
    train, test, loss = _baseline(MANY * 4 // 5, MANY // 5)
    assert (got.training_observations, got.test_observations, got.maximum_training_rows) == (train, test, None)
    assert train == 210_000 and got.baseline_log_loss == pytest.approx(loss, rel=1e-12)
    bounded = learners.treatment_predictability(df.where("id < 2000"), spec, sample_size=500).first()
    assert (bounded.training_observations, bounded.maximum_training_rows) == (500, 500)


def test_predictability_baseline_query_counts_every_training_row(spark, tmp_path):
    for name, rows in {
            "orders": spark.range(MANY).selectExpr(
                "id as o_orderkey", "id % 50 as o_custkey", "if(id % 2 = 0, 'F', 'O') as o_orderstatus",
                "cast(id % 977 as double) as o_totalprice",
                "cast(date_add(date'1995-01-01', cast(id % 900 as int)) as timestamp) as o_orderdate",
                "if(id % 3 = 0, '1-URGENT', '5-LOW') as o_orderpriority"),
            "lineitem": spark.range(MANY).selectExpr(
                "id as l_orderkey", "cast(id % 13 as double) as l_quantity", "cast(id % 89 as double) as l_extendedprice"),
            "customer": spark.range(50).selectExpr(
                "id as c_custkey", "cast(id % 5 as int) as c_nationkey", "cast(id as double) as c_acctbal",
                "if(id % 4 = 0, 'BUILDING', 'MACHINERY') as c_mktsegment"),
            "nation": spark.range(5).selectExpr("cast(id as int) as n_nationkey", "cast(id % 2 as int) as n_regionkey")}.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    arms = {r.treatment: r["count"] for r in experiment_table(spark, str(tmp_path)).groupBy("treatment").count().collect()}
    got = __spark_entry__.queries()["treatment_predictability_baseline"](spark, str(tmp_path)).first()
    train, test, loss = _baseline(arms[1], arms[0])
    assert (got.training_observations, got.test_observations) == (train, test) == (210_000, 70_000)
    assert got.baseline_log_loss == pytest.approx(loss, rel=1e-9)


def test_uplift_report_parallel_equals_serial(table):
    kw = dict(outcomes=["visit"], learner_names=("s_learner", "t_learner"), max_iterations=10)
    serial = analyze_uplift(table, ExperimentSpec(), **kw)
    parallel = analyze_uplift(table, ExperimentSpec(), parallelism=2, **kw)

    def rows(rep, name, drop=()):
        return sorted(tuple(r) for r in rep[name].drop(*drop).collect())

    assert rows(serial, "model_selection", ["fit_seconds"]) == \
        rows(parallel, "model_selection", ["fit_seconds"])
    assert rows(serial, "auuc") == rows(parallel, "auuc")
    split = {r.split: r.observations for r in serial["split_summary"].collect()}
    assert sum(split.values()) == 1473 and split["train"] == 883  # 1473 - ceil(0.4 * 1473) = 1473 - 590
    assert serial["targeting_policy"].where(F.col("fraction") == 1.0).count() == 2
    about = serial["modelling_population"].first()
    assert (about.source_rows, about.modelled_rows, about.random_seed) == (1473, 1473, 42)
    assert serial["feature_design"].groupBy("role").count().collect() and serial["feature_design"].count() == 12
    ate = serial["held_out_ate"].first()
    test_rows = serial["split_summary"].where("split = 'test'").first()
    assert ate.treatment_count == test_rows.treatment_count and ate.control_count == test_rows.control_count
    assert {r.held_out_test_ate for r in serial["cate_summary"].collect()} == {ate.observed_difference}
    assert serial["model_selection"].where("selected").count() == 2


@pytest.fixture
def counted(spark, table):
    """The table as a source that counts the rows it gives out, and the count."""
    given = spark.sparkContext.accumulator(0)

    def row(r):
        given.add(1)
        return r

    return spark.createDataFrame(spark.createDataFrame(table.collect(), table.schema).rdd.map(row), table.schema), given


def test_split_reads_its_input_once(counted):
    df, given = counted
    split = sampling.split_rows(df, 42)
    assert given.value == 1473  # the rows behind the cuts, and none yet for the split itself
    assert split.count() == 1473


@pytest.mark.parametrize("name", ["s_learner_scores", "t_learner_scores", "uplift_model_selection", "design_matrix"])
def test_learner_queries_read_the_table_once(spark, counted, monkeypatch, name):
    df, given = counted
    monkeypatch.setattr(__spark_entry__, "_exp", lambda *_: df)
    assert __spark_entry__.queries()[name](spark, SF).count()
    assert given.value == 1473


def test_uplift_report_reads_the_table_once_and_bounds_its_fits(counted, monkeypatch):
    df, given = counted
    seen = {}
    fit, evaluate = learners.fit_candidates, learners.evaluate_model

    def fits(*args, parallelism, **kw):
        seen["fits"] = parallelism
        return fit(*args, parallelism=parallelism, **kw)

    def evaluation(*args, **kw):
        rep = evaluate(*args, **kw)
        seen["columns"] = rep.scored.columns
        return rep

    monkeypatch.setattr(learners, "fit_candidates", fits)
    monkeypatch.setattr(learners, "evaluate_model", evaluation)
    monkeypatch.setattr(uplift, "FIT_ROWS_AT_ONCE", 2 * 883)  # twice the training rows
    analyze_uplift(df, ExperimentSpec(), outcomes=["visit"], learner_names=("t_learner",), max_iterations=2,
                   parallelism=4)
    assert given.value == 1473
    assert seen == {"fits": 2, "columns": ["id", "treatment", "visit", "p1", "p0", "cate"]}
