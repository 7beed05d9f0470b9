"""Per-segment results (``by``) equal the operator run on each segment alone."""

import pytest
from pyspark.sql import functions as F

from liftlab.operators import balance, effects, population, power
from liftlab.sources.overlay import experiment_table
from liftlab.spec import ExperimentSpec

SPEC = ExperimentSpec()


@pytest.fixture(scope="module")
def table(spark):
    return experiment_table(spark, "/root/testdata/sf0.001").cache()


def _rows(df, key, drop=()):
    return {r[key]: r.asDict() for r in df.drop(*drop).collect()}


@pytest.mark.parametrize("op", ["itt", "population", "mde", "continuous"])
def test_segment_rows_equal_filtered_runs(table, op):
    run = {
        "itt": lambda d, by: effects.itt_effects(d, SPEC, by=by),
        "population": lambda d, by: population.population_summary(d, SPEC, by),
        "mde": lambda d, by: power.mde_grid(d, SPEC, by),
        "continuous": lambda d, by: balance.continuous_balance(d, SPEC, by),
    }[op]
    segmented = run(table, ["f4"]).collect()
    for seg in ("BUILDING", "MACHINERY"):
        alone = run(table.where(F.col("f4") == seg), []).collect()
        mine = [r.asDict() for r in segmented if r.f4 == seg]
        for r in mine:
            r.pop("f4")
        key = lambda r: tuple(str(v) for v in r.values())
        got = sorted(mine, key=key)
        want = sorted((r.asDict() for r in alone), key=key)
        assert len(got) == len(want) > 0
        for g, w in zip(got, want):
            assert g.keys() == w.keys()
            for k in g:
                if isinstance(w[k], float):
                    assert g[k] == pytest.approx(w[k], rel=1e-12, abs=1e-15), k
                else:
                    assert g[k] == w[k], k


def test_null_segment_keeps_its_levels(spark):
    rows = [(None, "a", 1), (None, "b", 0), ("s", "a", 1), ("s", "a", 0)]
    df = spark.createDataFrame(rows, "seg string, f1 string, treatment int")
    spec = ExperimentSpec(features=("f1",), continuous=(), categorical=("f1",))
    out = balance.categorical_level_balance(df, spec, by=["seg"]).collect()
    assert len(out) == 3
    null_a = [r for r in out if r.seg is None and r.level == "a"][0]
    assert null_a.treatment_proportion == 1.0 and null_a.control_proportion == 0.0
