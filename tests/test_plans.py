"""Plan shape: pruning reaches the scan, aggregates are partial, no Python in the hot path."""

import re

import pytest

from liftlab.operators import balance, effects, population
from liftlab.sources.overlay import experiment_table
from liftlab.spec import ExperimentSpec


@pytest.fixture(scope="module")
def parquet(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "exp.parquet")
    experiment_table(spark, "/root/testdata/sf0.001").write.parquet(path)
    return spark.read.parquet(path)


def _plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def _read_schemas(plan):
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)


def test_population_reads_only_binaries(parquet, capsys):
    plan = _plan(population.population_summary(parquet, ExperimentSpec()), capsys)
    (schema,) = _read_schemas(plan)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == [
        "conversion", "exposure", "treatment", "visit"]
    assert plan.count("HashAggregate") >= 2  # partial + final around one exchange
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_effects_keep_normal_tails_in_the_jvm(parquet, capsys):
    plan = _plan(effects.itt_effects(parquet, ExperimentSpec(), by=["f4"]), capsys)
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    (schema,) = _read_schemas(plan)
    assert "f0" not in schema and "f4" in schema


def test_categorical_balance_scans_features_once_without_a_window(parquet, capsys):
    out = balance.categorical_level_balance(parquet, ExperimentSpec())
    out.collect()
    # As executed: the arm totals read the shuffle of the level counts again.
    plan = out._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan and "Window" not in plan
    (schema, _) = _read_schemas(_plan(balance.categorical_level_balance(parquet, ExperimentSpec()), capsys))
    assert "treatment" in schema and "f1" in schema and "f0" not in schema and "visit" not in schema
