"""Mixing: targets, copies and positions against plain versions, and odd rows."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from liftlab.llm import mixing
from test_pipeline import plain_mix, plain_targets

SF = "/root/testdata/sf0.01"


def plain_time(share, knots):
    """Time at which the integral of a piecewise-linear schedule reaches a share, by a fine grid."""
    t = np.linspace(0, 1, 200_001)
    w = np.interp(t, np.linspace(0, 1, len(knots)), knots)
    area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    return float(np.interp(share, area / area[-1], t))


@pytest.mark.parametrize("knots", [(1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (2.0, 1.0), (1.0, 3.0, 1.0, 0.5)])
def test_inverse_of_the_integral(spark, knots):
    shares = [0.0, 1e-6, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    got = [r[0] for r in df.select(mixing.time_of(F.col("s"), knots)).collect()]
    assert got == pytest.approx([plain_time(s, knots) for s in shares], abs=1e-4)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, "c": 1000, "d": 5}, {"a": 0, "b": 7}, {"a": 0},
                                   {chr(97 + i): (i * 7919) % 97 for i in range(20)}, {}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_copies_match_a_plain_walk(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = mixing.query(spark, SF).toPandas().set_index("doc_id")
    copies, targets, sizes = plain_mix(rows)
    for d, _, s in rows:
        r = got.loc[d]
        assert r.taken == copies[d] * r["size"] <= 3 * r["size"] and r.source_size == sizes[s]
        assert r.target == pytest.approx(targets[s], abs=1e-3)
    again = mixing.query(spark, SF).toPandas().set_index("doc_id")
    assert again.sort_index().equals(got.sort_index())


def test_many_ranges_change_nothing(spark):
    before = mixing.query(spark, SF).toPandas().set_index("doc_id").sort_index()
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "53")
    try:
        assert mixing.query(spark, SF).toPandas().set_index("doc_id").sort_index().equals(before)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_every_copy_has_its_place(spark):
    got = mixing.query(spark, SF).toPandas()
    places = got[["place_1", "place_2", "place_3"]].to_numpy().ravel()
    places = np.sort(places[~np.isnan(places)]).astype(int)
    assert (got["size"] > 0).any() and places.tolist() == list(range(len(places)))
    taken = got[got["size"] > 0]
    assert (taken[["place_1", "place_2", "place_3"]].notna().sum(axis=1) * taken["size"] == taken.taken).all()
    first = got[got.place_1.notna()].sort_values("place_1")
    assert (np.diff(first.position) >= 0).all()


@pytest.mark.parametrize("repeated", [False, True])
def test_a_third_of_the_rows_without_an_id(spark, repeated):
    n, text = 30_000, "1" if repeated else "id"
    docs = spark.range(n).selectExpr("if(id % 3 = 0, null, id) as doc_id", "'hot' as source",
                                     "if(id % 3 = 0, 4, id % 7) as n", f"{text} as x")
    rows = mixing.stored(docs.selectExpr(
        "'s' as of", "coalesce(cast(doc_id as string), '') as key", "cast(n as long) as size",
        "monotonically_increasing_id() as number"), "test-rows")
    begun = mixing._in_stream_order(rows, ["key", "size", "number"])
    plain = rows.toPandas().sort_values(["key", "size", "number"])
    plain["begin"] = plain["size"].cumsum() - plain["size"]
    got = begun.toPandas().sort_values("number").begin.to_list()
    assert got == plain.sort_values("number").begin.to_list()
    m = mixing.mix(docs, F.col("n")).toPandas()
    assert len(m) == n and abs((m.mix_size * m.mix_copies).sum() - m.mix_target[0]) < 7


def test_hot_key_is_cut_into_ranges(spark):
    rows = spark.range(40_000).selectExpr("'s' as of", "'' as key", "1L as size", "id as number")
    stored = []
    real = mixing.stored
    try:
        mixing.stored = lambda df, name: stored.append(real(df, name)) or stored[-1]
        mixing._in_stream_order(rows, ["key", "size", "number"]).count()
    finally:
        mixing.stored = real
    ranges = stored[0].groupBy(F.shiftright("at", 33)).count().toPandas()["count"]
    assert len(ranges) > 1 and ranges.max() < 2 * ranges.sum() / len(ranges)


def test_the_curriculum_moves_weight_over_time(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "array('a','b','c')[id % 3] as source", "10 as n")
    m = mixing.mix(docs, F.col("n"))
    ordered = [r["source"] for r in mixing.training_order(m).collect()]
    third = len(ordered) // 3
    assert ordered[:third].count("a") > 1.3 * ordered[-third:].count("a")
    assert ordered[-third:].count("c") > 1.3 * ordered[:third].count("c")


def test_odd_rows(spark):
    rows = [(1, "s", 5), (1, "s", 5), (None, "s", 3), (2, None, 4), (3, None, 0), (4, "", 2), (5, "é", 1), (6, "z", 10_000), (7, "empty", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long").withColumns(
        {"target": F.lit("clash"), "source_size": F.lit(1), "tier": F.lit(2), "level": F.lit(3), "row": F.lit(4), "bucket": F.lit(5), "_position": F.lit(6), "_at": F.lit(7),
         "number": F.lit(8), "hash": F.lit(9), "range": F.lit(10)})
    m = mixing.mix(docs, F.coalesce("n", F.lit(0)))
    got = m.toPandas()
    assert len(got) == len(rows) and {"target", "source_size", "tier"} <= set(got.columns)
    assert set(got[got.source.isna()].mix_source_size) == {4}
    assert (got.mix_copies <= 3).all() and (got.mix_copies >= 0).all()
    assert got[got.source == "empty"].mix_target.iloc[0] == 0
    out = mixing.training_order(m)
    assert out.columns == docs.columns and out.count() == got.mix_copies.sum()
    assert mixing.training_order(mixing.mix(docs.limit(0), F.col("n"))).count() == 0


def test_a_table_with_the_operators_own_names(spark):
    docs = spark.range(12).selectExpr("id as doc_id", "'s' as source", "id as n", "map('a', id) as nested", *[
        f"'clash' as {c}" for c in mixing.OWN_COLUMNS])
    m = mixing.mix(docs, F.col("n"))
    assert m.columns == docs.columns + [f"_{c}" for c in mixing.OWN_COLUMNS]
    out = mixing.training_order(m).toPandas()
    assert list(out.columns) == docs.columns and set(out.mix_size) == set(out.mix_positions) == {"clash"}
    assert len(out) == m.agg(F.sum("_mix_copies")).first()[0] > 0
