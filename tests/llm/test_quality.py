"""Quality classifier: features and updates against plain versions, held-out accuracy."""

import math

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from liftlab.llm import quality

SF = "/root/testdata/sf0.01"


def plain_features(text, bits=quality.BITS):
    mask, a, b = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    words, out = (text or "").split(), []
    for seed, kind in ((0, str.lower), (1, quality.shape)):
        last = 1
        for w in words:
            h = xxhash.xxh3_64_intdigest(kind(w), seed)
            out.append((h * a & mask) >> (64 - bits))
            x, y = (2, 2) if seed == 0 and h == last else (last, h)
            out.append(((((x * b) ^ (y * a + b)) & mask) * a & mask) >> (64 - bits))
            last = h
    return sorted(out)


def test_features_match_a_plain_version():
    texts = ["a b c", "Go go Go!! GO!! x_ %%% %%%", None, "", "  One two ", "x", "a b c d e f", "\t"]
    f, ends = quality.features(pa.array(texts))
    assert [sorted(f[a:b].tolist()) for a, b in zip(ends, ends[1:])] == [plain_features(t) for t in texts]
    f, ends = quality.features(pa.array([None, ""], pa.string()))
    assert len(f) == 0 and ends.tolist() == [0, 0, 0]


def test_update_matches_the_formulas():
    s = quality.State.empty(4)
    s.z[[2, 5]] = [1.0, -0.5]
    s.n[[2, 5]] = [4.0, 1.0]
    want = {i: (s.z[i], s.n[i]) for i in (2, 5, 16)}

    def w(z, n):
        if abs(z) <= quality.L1:
            return 0.0
        return -(z - math.copysign(quality.L1, z)) / ((quality.BETA + math.sqrt(n)) / quality.ALPHA + quality.L2)

    x = {2: 2 / math.sqrt(3), 5: 1 / math.sqrt(3), 16: 1.0}
    p = 1 / (1 + math.exp(-sum(w(*want[i]) * x[i] for i in x)))
    s.update(np.array([2, 5, 2]), np.array([0, 3]), np.array([1.0]))
    for i in x:
        z, n = want[i]
        g = (p - 1) * x[i]
        assert s.n[i] == pytest.approx(n + g * g)
        assert s.z[i] == pytest.approx(z + g - (math.sqrt(n + g * g) - math.sqrt(n)) / quality.ALPHA * w(z, n))


def test_held_out_accuracy_and_whole_table(spark):
    got = quality.query(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").dropna(subset=["quality"])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count()
    pdf = got.join(labels, "doc_id").where("held_out").toPandas()
    assert pdf["score"].between(0, 1).all()
    pos, neg = pdf[pdf.quality == 1].score, pdf[pdf.quality == 0].score
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.9, auc
    assert (pdf.predicted == pdf.quality).mean() > 0.9


def test_nulls_repeats_clashes_and_no_labels(spark):
    rows = [(1, "good text here", "a"), (1, "good text here", "b"), (None, None, "c"), (2, "", None), (3, "bad %%%", "d"),
            (4, "w " * 200_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("label", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (2, None), (None, 1), (99, 1)], "doc_id long, quality int")
    w = quality.fit(quality.labelled_rows(docs, labels))
    got = quality.with_score(docs, w, "q").toPandas()
    assert got.columns.tolist() == [*docs.columns, "q"] and len(got) == 6 and got["q"].between(0, 1).all()
    assert got[got.doc_id.isna()].q.iloc[0] == got[got.doc_id == 2].q.iloc[0]
    w = quality.fit(quality.labelled_rows(docs, labels.limit(0)))
    assert set(quality.with_score(docs, w, "q").toPandas()["q"]) == {0.5}
    assert quality.with_score(docs.limit(0), w, "q").count() == 0


def test_sample_bound(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'t' as text")
    labels = spark.range(5000).selectExpr("id as doc_id", "1 as quality")
    n = quality.labelled_rows(docs, labels, train_rows=1000).count()
    assert 850 < n < 1150
