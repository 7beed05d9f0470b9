"""Allocation, SMD, categorical balance, ITT effect and population counts."""

import math

import pytest
from pyspark.sql import functions as F

from liftlab.operators import balance, effects, population
from liftlab.spec import ExperimentSpec


def test_allocation_matches_design(spark):
    pop = spark.createDataFrame([(100, 85)], "total_count long, treatment_count long")
    row = effects.allocation_from_counts(pop, 0.85).first()
    assert row.z_statistic == pytest.approx(0.0)
    assert row.p_value == pytest.approx(1.0)
    assert row.proportion_difference == pytest.approx(0.0)


def test_standardized_mean_difference(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0, 1.0), (2.0, 2.0, 0.0, 0.0), (2.0, 1.0, 0.0, 0.0)],
                               "m1 double, m0 double, s1 double, s0 double")
    got = [r[0] for r in df.select(balance.smd_column(
        F.col("m1"), F.col("m0"), F.col("s1"), F.col("s0"))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == 0.0 and math.isinf(got[2])


def _levels(spark, treated, control):
    rows = [(lvl, 1) for lvl, n in treated.items() for _ in range(n)]
    rows += [(lvl, 0) for lvl, n in control.items() for _ in range(n)]
    return spark.createDataFrame(rows, "x string, treatment int")


SPEC_X = ExperimentSpec(continuous=(), categorical=("x",), features=("x",))


def test_categorical_balance_unequal(spark):
    df = _levels(spark, {"a": 80, "b": 19, "rare": 1}, {"a": 50, "b": 50})
    row = balance.categorical_balance(df, SPEC_X).first()
    assert row.level_count == 3
    assert row.maximum_absolute_standardized_difference > 0
    assert row.weighted_rms_standardized_difference > 0


def test_categorical_balance_equal(spark):
    df = _levels(spark, {"a": 70, "b": 30}, {"a": 70, "b": 30})
    row = balance.categorical_balance(df, SPEC_X).first()
    assert row.maximum_absolute_standardized_difference == 0
    assert row.weighted_rms_standardized_difference == 0


def test_binary_outcome_effect(spark):
    counts = spark.createDataFrame([(60, 100, 40, 100)], "treatment_positive long, "
                                   "treatment_count long, control_positive long, control_count long")
    r = effects.effects_from_counts(counts).first()
    assert r.absolute_risk_difference == pytest.approx(0.2)
    assert r.absolute_risk_difference_ci_lower == pytest.approx(0.06420971191085939, rel=1e-12)
    assert r.absolute_risk_difference_ci_upper == pytest.approx(0.33579028808914063, rel=1e-12)
    assert r.relative_risk == pytest.approx(1.5)
    assert r.relative_lift == pytest.approx(0.5)
    assert r.relative_lift_percent == pytest.approx(50.0)
    assert r.incremental_outcomes_per_100000_assigned == pytest.approx(20000)
    # pooled z test: p = 0.5, se = sqrt(0.25 * 0.02)
    z = 0.2 / math.sqrt(0.25 * 0.02)
    assert r.z_statistic == pytest.approx(z)
    assert r.p_value == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-12)


def test_effect_without_events_has_no_relative_risk(spark):
    counts = spark.createDataFrame([(0, 50, 0, 50)], "treatment_positive long, "
                                   "treatment_count long, control_positive long, control_count long")
    r = effects.effects_from_counts(counts).first()
    assert r.relative_risk is None and r.z_statistic == 0.0 and r.p_value == pytest.approx(1.0)


def test_assignment_not_exposure_and_duplicates_kept(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 1, 0), (1, 1, 1, 1)],
                               "treatment int, exposure int, visit int, conversion int")
    pop = population.population_summary(df).first()
    assert pop.total_count == 4 and pop.control_count == 2 and pop.exposure_treatment == 1
    visit = effects.itt_effects(df).where("outcome = 'visit'").first()
    assert visit.absolute_risk_difference == pytest.approx(1.0)


def test_transformed_outcome_literals(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (1, 0)], "visit int, treatment int")
    out = [r.transformed_outcome for r in
           effects.transformed_outcome(df, "visit", propensity=0.8).collect()]
    assert out == pytest.approx([1.25, -5.0, 0.0, -5.0])
    with pytest.raises(ValueError):
        effects.transformed_outcome(df, "visit", propensity=1.0)
