"""Hilbert sharding: the curve itself, the law of the shards, and pruning."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftlab.llm import sharding

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 1), (2, 4), (3, 1), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_unit_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = sharding.hilbert_index(list(cells.T), bits)
    assert sorted(index) == list(range(len(cells)))
    walk = cells[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_whole_table(spark):
    got = sharding.query(spark, SF).toPandas()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(text)
    for r in got.itertuples():
        assert r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id])
    counts = got.groupby("shard").size()
    assert counts.index.tolist() == list(range(16)) and counts.max() - counts.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert (got.sort_values(["shard", "slot"]).hilbert.diff().dropna() >= 0).all()
    assert set(got.law) == {"rows"} and got.grown_shard.isna().all()


def test_runs_prune_better_than_an_unordered_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharded = sharding.shard_rows(docs.select("doc_id", "source", "lang", "n_chars"), ["source", "lang", "n_chars"], ["doc_id"])
    p = sharded.toPandas()

    def kept(groups):
        """Shards whose minimum and maximum admit a value, over all values of all dimensions."""
        out = 0
        for c in ("source", "lang", "n_chars"):
            lo, hi = groups[c].min(), groups[c].max()
            out += sum(((lo <= v) & (v <= hi)).mean() for v in p[c].unique()) / p[c].nunique()
        return out / 3

    assert kept(p.groupby("shard")) < 0.75 * kept(p.groupby(p.doc_id % 16))
    sharding.write_shards(sharded, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == len(p) and set(back.columns) == set(sharded.columns)


@pytest.mark.parametrize("n", [0, 1, 5, 16, 33])
def test_odd_rows(spark, n):
    rows = [(None if i % 4 == 0 else i // 2, None if i % 3 == 0 else "é" * i, None if i % 5 == 0 else float(i), "x") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size double, rank string").withColumn("_part", F.lit("clash"))
    got = sharding.shard_rows(df, ["source", "size"], ["doc_id"], shards=4).toPandas()
    assert len(got) == n and {"rank", "_part"} <= set(got.columns)
    counts = [int((got["shard"] == s).sum()) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    for s in range(4):
        assert sorted(got[got["shard"] == s].slot) == list(range(counts[s]))


def test_strings_are_placed_whole(spark):
    """Values that share their first 20 bytes still spread over the cells of their dimension."""
    rows = [(i, f"https://example.org/{'x' * 200}/{i % 40:03d}" if i % 5 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    bounds = sharding.string_bounds(df, "source", 32)
    assert 25 <= len(bounds) <= 31 and bounds == sorted(bounds)
    cells = df.select("source", sharding.string_cell(F.col("source"), bounds).alias("cell")).toPandas()
    counts = cells.dropna().groupby("cell").size()
    assert len(counts) == len(bounds) + 1 and counts.max() <= 3 * 40
    by_value = cells.dropna().groupby("source").cell.agg(["min", "max"]).sort_index()
    assert (by_value["min"] == by_value["max"]).all() and by_value["min"].is_monotonic_increasing
    got = sharding.shard_rows(df, ["source"], ["doc_id"]).toPandas()
    ranges = got.dropna().groupby("shard").source.agg(["min", "max"])
    assert (ranges["max"].to_numpy()[:-1] <= ranges["min"].to_numpy()[1:]).all() and ranges["max"].nunique() > 10


def test_a_value_with_a_third_of_all_rows(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(6)
    bounds = sharding.string_bounds(df, "source", 8)
    assert bounds == sorted(set(bounds)) and 4 <= len(bounds) <= 7
    cells = df.select("source", sharding.string_cell(F.col("source"), bounds).alias("cell")).where("source <> 'hot'").groupBy("cell").count().toPandas()
    assert cells["count"].max() < 2 * 3000 / 8
    assert sharding.string_bounds(df.limit(0), "source", 8) == []


def test_clashing_names_of_the_operator(spark):
    df = spark.createDataFrame([(i, f"s{i}") for i in range(20)], "doc_id long, source string").withColumns(
        {c: F.lit("clash") for c in ("hilbert", "shard", "slot", "value", "n", "at", "part", "upto", "_rank")})
    got = sharding.shard_rows(df, ["source"], ["doc_id"], shards=4)
    assert sorted(got.columns) == sorted(df.columns)
    p = got.toPandas()
    assert sorted(p["shard"].unique()) == [0, 1, 2, 3] and set(p["value"]) == set(p["_rank"]) == {"clash"}
    kept = sharding.shard_rows(df, ["source"], ["doc_id"], columns={"hilbert": "h", "shard": "s", "slot": "t"}).toPandas()
    assert set(kept["shard"]) == {"clash"} and sorted(kept["s"].unique()) == list(range(16))
