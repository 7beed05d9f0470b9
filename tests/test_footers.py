"""Parquet footers, the files that prepare writes, listed bad values, level totals from one scan."""

import gzip

import pytest
from pyspark.sql import functions as F

from liftlab.operators import balance, validate
from liftlab.sources.footers import file_summary, parquet_footers
from liftlab.sources.ingest import prepare_dataset
from liftlab.spec import ExperimentSpec, ValidationError


@pytest.mark.parametrize("through_spark", [None, True])
def test_footers_tell_rows_codecs_and_bounds(spark, tmp_path, through_spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 4 > 0, F.col("id") / 2).alias("x"), (F.col("id") % 3).cast("string").alias("s"))
    df.repartition(3).write.option("compression", "zstd").parquet(str(tmp_path / "a"))
    df.coalesce(1).write.option("compression", "snappy").parquet(str(tmp_path / "b" / "c"))
    got = parquet_footers(spark, str(tmp_path), through_spark=through_spark)
    rows = got.collect()
    assert len(rows) == 4 * 3 and {r.codec for r in rows} == {"ZSTD", "SNAPPY"}
    s = [r for r in rows if r.column_name == "s"]
    assert all(r.dictionary and (r.minimum, r.maximum) == ("0", "2") for r in s)
    assert sum(r.null_count for r in rows if r.column_name == "x") == 2 * 250
    files = file_summary(got).collect()
    assert sorted(f.rows for f in files)[-1] == 1000 and sum(f.rows for f in files) == 2000
    assert all(f.columns == 3 and f.row_groups == 1 and f.all_bounded for f in files)


def test_no_footers_without_files(spark, tmp_path):
    assert parquet_footers(spark, str(tmp_path)).count() == 0


def test_prepare_writes_zstd_dictionaries_and_statistics(spark, tmp_path):
    body = "".join(f"{i % 9}.5,{i % 5},{i % 2},0,1,0\n" for i in range(5000))
    with gzip.open(tmp_path / "raw.csv.gz", "wt") as fh:
        fh.write("f0,f1,treatment,conversion,visit,exposure\n" + body)
    prepare_dataset(spark, str(tmp_path / "raw.csv.gz"), str(tmp_path / "out"))
    rows = parquet_footers(spark, str(tmp_path / "out")).collect()
    assert {r.codec for r in rows} == {"ZSTD"} and {r.column_name for r in rows} == {
        "f0", "f1", "treatment", "conversion", "visit", "exposure"}
    assert all(r.minimum is not None and r.null_count == 0 for r in rows)
    assert all(r.dictionary for r in rows if r.column_name in ("f0", "f1"))


def test_invalid_values_are_exact_and_ranked(spark):
    spec = ExperimentSpec(features=("x",), continuous=("x",), categorical=())
    df = spark.range(1000).select(F.lit(1.0).alias("x"), F.when(F.col("id") % 3 == 0, 2.0).when(F.col("id") % 3 == 1, 0.5).when(
        F.col("id") > 500, F.col("id")).alias("treatment"), F.lit(1).alias("visit"),
        F.when(F.col("id") < 10, F.col("id") - 5).otherwise(0).alias("conversion"), F.lit(None).cast("int").alias("exposure"))
    got = [tuple(r) for r in validate.invalid_values(df, spec, k=3).orderBy("column_name", "rank").collect()]
    assert got == [("conversion", -5.0, 1, 1), ("conversion", -4.0, 1, 2), ("conversion", -3.0, 1, 3),
                   ("treatment", 2.0, 334, 1), ("treatment", 0.5, 333, 2), ("treatment", 503.0, 1, 3)]
    plan = validate.invalid_values(df, spec, k=3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    with pytest.raises(ValidationError, match="treatment: 2.0 in 334 rows, 0.5 in 333 rows"):
        validate.assert_binary(validate.binary_profile(df, spec), df, spec)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_level_balance_scans_the_table_once(spark, tmp_path, by):
    spec = ExperimentSpec(features=("a", "b"), continuous=(), categorical=("a", "b"))
    spark.range(500).select((F.col("id") % 4).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("b"), (F.col("id") % 2).alias("treatment"),
                            F.when(F.col("id") % 11 > 2, F.col("id") % 3).alias("g")).write.parquet(str(tmp_path / "t"))
    out = balance.categorical_level_balance(spark.read.parquet(str(tmp_path / "t")), spec, by)
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "ReusedExchange" in plan
    for f in "ab":
        for g in {tuple(r[c] for c in by) for r in rows}:
            mine = [r for r in rows if r.feature == f and tuple(r[c] for c in by) == g]
            assert sum(r.treatment_proportion for r in mine) == pytest.approx(1)
            assert sum(r.pooled_weight for r in mine) == pytest.approx(1)
