"""Shared helpers: words and global order."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from liftlab.llm import common

TEXTS = ["Aa bB", None, "", " \t x\x0by\x0cz \n", "à Åb\u0085c d", "É", "a\x1cb", "  ", "x" * 50_000, "漢 字\r\nQ"]


@pytest.mark.parametrize("lower", [True, False])
def test_coded_words(lower):
    for texts in (pa.array(TEXTS), pa.array(["zz", *TEXTS, None]).slice(1, len(TEXTS)), pa.array([], pa.string())):
        code, bounds, names = common.coded_words(texts, lower)
        got = [[names[c].decode() for c in code[a:b]] for a, b in zip(bounds, bounds[1:])]
        want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts.to_pylist()]
        if lower:
            want = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in ws] for ws in want]
        assert got == want


def test_words_column(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in df.select(common.words(F.col("t"))).collect()]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]


def test_ranked(spark):
    df = common.stored(spark.range(1000).selectExpr("id % 7 as a", "id % 3 as b", "id"), "t")
    rows = common.ranked(df, ["a", "b", "id"], "t").collect()
    assert [(r["a"], r["b"], r["id"]) for r in sorted(rows, key=lambda r: r["rank"])] == sorted(
        (r["a"], r["b"], r["id"]) for r in rows)
    assert sorted(r["rank"] for r in rows) == list(range(1000))
    assert common.ranked(common.stored(df.limit(0), "t"), ["a"], "t").count() == 0


def test_chunks_cover_the_batch(monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 10)
    b = pa.record_batch([pa.array(["aaaa", None, "b" * 50, "", "cc"])], names=["t"])
    assert [x for c in common.chunks(b, 0) for x in c.column(0).to_pylist()] == b.column(0).to_pylist()
    assert list(common.chunks(b.slice(0, 0), 0)) == []
