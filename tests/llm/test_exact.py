"""Exact duplicates against a dictionary of texts; the directory; chains, pages and odd rows."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftlab.llm import exact

SF = "/root/testdata/sf0.01"


def plain(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        # One row of a group is kept, even where its id is repeated.
        out += [(i, keep, len(ids), sha) for i in ids]
    return out


def check(got, rows):
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()]
    assert sorted((r[:4] for r in got), key=key) == sorted(plain(rows), key=key)
    kept = [r for r in got if r[4]]
    assert all(r[0] == r[1] for r in kept)
    assert len(kept) == len({r[3] for r in got}) == len({r[3] for r in kept})


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(exact.query(spark, SF), rows)


def texts(n):
    """A third of all rows hold one text; the others many smaller groups."""
    return [(i, "hot" * 200 if i % 3 == 0 else f"text {i % 97}" * (i % 7)) for i in range(n)]


@pytest.mark.parametrize("key_bits", [64, 2, 1])
def test_collisions_are_chained(spark, key_bits):
    rows = texts(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(exact.duplicates(docs, key_bits=key_bits), rows)


def test_overfull_buckets_split_or_get_pages(spark, monkeypatch):
    monkeypatch.setattr(exact, "LEAST_BYTES", 1)
    monkeypatch.setattr(exact, "PAGE_ENTRIES", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = texts(1500)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        segments = exact.write_segments(docs)
        assert segments.where("size > 1").count() > 100  # folded before the shuffle
        d = exact.make_directory(segments, 2000)
        assert d.depth > 3 and d.pages.max() > 4 and len(d.pointers) == 1 << d.depth
        check(exact.duplicates(docs, bucket_bytes=2000), rows)
        index = exact.build(docs, bucket_bytes=2000)
        sizes = index.classes.where("entry = head").agg(F.sum("size")).first()[0]
        assert sizes == len(rows) and index.directory.agg(F.sum("entries")).first()[0] == segments.count()
        # No owner reads much more than its capacity.
        owners = index.classes.select(F.col("entry")).join(segments, "entry").select("key", "entry", "n_bytes").toPandas()
        unit, _ = d.unit(owners.key.to_numpy(), owners.entry.to_numpy())
        assert np.bincount(unit, owners.n_bytes + exact.ENTRY_BYTES).max() < 4 * 2000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_directory_points_by_leading_bits():
    loads = np.array([0, 0, 9, 9, 1, 1, 1, 1, 30, 0, 0, 0, 0, 0, 0, 2], dtype=np.int64)
    d = exact.Directory(loads, loads, loads == 30, 10)
    assert d.depth == 4 and d.pages.max() == 3 and not d.overfull
    for prefix in range(16):
        b = d.pointers[prefix]
        assert d.first[b] <= prefix < d.first[b] + (1 << (4 - d.local[b]))
    assert sorted(d.first) == sorted(set(d.first)) and d.bytes.sum() == loads.sum()
    assert all(x <= 10 or p > 1 for x, p in zip(d.bytes, d.pages))
    assert exact.Directory(np.zeros(2, int), np.zeros(2, int), np.zeros(2, bool), 1).units == 1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a"), (None, "a"), (None, "a "), (5, "a "), (3, "é"), (4, "é"),
            (6, "x" * 3_000_000), (7, "x" * 3_000_000), (8, "x" * 2_999_999 + "y"), (-9, "A"), (9, "\x00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {n: F.lit(1) for n in ("entry", "key", "kept", "keep_id", "group_size", "ids")})
    check(exact.duplicates(docs), rows)
    check(exact.duplicates(docs.repartition(5)), rows)
    assert exact.duplicates(docs.limit(0)).collect() == []
