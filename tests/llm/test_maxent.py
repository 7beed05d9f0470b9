"""Language-model scoring: counts against brute force, a proper distribution, held-out gain."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from liftlab.llm import maxent

SF = "/root/testdata/sf0.01"


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


@pytest.fixture(scope="module")
def scored(spark):
    return maxent.query(spark, SF).toPandas().set_index("doc_id").sort_index()


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}


def test_counts_and_base_score_match_brute_force(scored, texts):
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    c = Counter(t for d, x in texts.items() if not out[d] for t in tokens(x))
    n, v = sum(c.values()), len(c)
    assert len(scored) == len(texts) and set(scored.train_tokens) == {n}
    for d, x in texts.items():
        r, ts = scored.loc[d], tokens(x)
        assert r.held_out == out[d] and r.n_tokens == len(ts)
        assert r.n_known == sum(c[t] > 0 for t in ts)
        want = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)
        assert r.base_score == pytest.approx(want, rel=1e-9)


def test_the_model_beats_the_base_on_held_out_texts(scored):
    held = scored[scored.held_out]
    assert held.score.sum() > held.base_score.sum() + 0.05 * held.n_tokens.sum()
    assert (held.score > held.base_score).mean() > 0.8
    assert (scored.score < 0).all()


def test_words_joined_and_words_broadcast_give_one_result(spark, scored):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = maxent.train(docs.where(~maxent.held_out()), frequent_words=100)
    assert len(model.frequent[0]) <= 100
    got = maxent.score(docs, model).toPandas().set_index("doc_id").sort_index()
    assert (got.n_known == scored.n_known).all()
    assert np.allclose(got.base_score, scored.base_score, rtol=1e-9)
    own = {k: v for k, v in model.own.items()}
    assert len(own) == maxent.OWN_CLASSES


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, "a b c a the dog" if i % 2 else "x y z") for i in range(20)], "doc_id long, text string")
    model = maxent.train(docs)
    words = ["a", "b", "c", "the", "dog", "x", "y", "z"]
    counts = {r["h"]: r["c"] for r in model.counts.collect()}
    t = maxent.Tokens.of(pa.array(["a b"]), model.own)
    e = maxent.class_exponentials(model.weights, t.feature_rows())[1].astype(float)
    p_class = e / e.sum()
    inner = np.ones(maxent.CLASSES)  # a class's share for words never seen
    for w in words:
        u = maxent.Tokens.of(pa.array([w]), model.own)
        inner[u.cls[0]] += counts[int(u.hash[0])] + 1
    inner[0] += counts[int(maxent.END)] + 1
    assert np.allclose(inner, model.class_total)
    assert p_class.sum() == pytest.approx(1.0)


def test_draws_follow_the_model():
    rng = np.random.default_rng(0)
    e = np.tile(np.arange(64, dtype=np.float32) % 5, (40_000, 1))
    got = np.bincount(maxent.draw(e, rng), minlength=64) / 40_000
    assert np.abs(got - e[0] / e[0].sum()).max() < 0.005


def test_merge_is_the_mean_over_copies_that_touched_a_row():
    import pandas as pd
    a, b = np.zeros((2, 64), "<f2"), np.zeros((2, 64), "<f2")
    a[0], b[0], b[1] = 1.0, 3.0, 5.0
    rows = pd.DataFrame({"hits": [np.array([1, 0], "<i4").tobytes(), np.array([2, 1], "<i4").tobytes()],
                         "change": [a.tobytes(), b.tobytes()]})
    out = maxent._merge((0, 0), rows)
    got = np.frombuffer(out["change"][0], "<f2").reshape(2, 64)
    assert got[0, 0] == pytest.approx((1 + 2 * 3) / 3, rel=1e-3) and got[1, 0] == 5


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(1, "A b", 1), (1, "a B", 2), (None, None, 3), (2, "", 4), (3, "q " * 100_000, 5), (None, "a b", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").withColumns(
        {"h": F.lit("x"), "times": F.lit(1), "score": F.lit("s")})
    got = maxent.score(docs, maxent.train(docs)).toPandas()
    assert len(got) == 6 and sorted(got.n_tokens) == [1, 1, 3, 3, 3, 100_001]
    assert got[got.doc_id == 1].score.nunique() == 1
    assert (got.n_known == got.n_tokens).all()
    none = maxent.train(docs.limit(0))
    assert none.n == none.v == 0
    got = maxent.score(docs, none).toPandas()
    assert (got.n_known == 0).all() and np.isfinite(got.score).all()
    assert maxent.score(docs.limit(0), none).count() == 0


def in_one_class(spark):
    """Texts where the word before tells two words of one class apart; a model of them."""
    common = " ".join(f"f{i} f{i}" for i in range(maxent.OWN_CLASSES))
    rows = [(i, f"{common} {'red aqq' if i % 2 else 'blue bqq'}") for i in range(400)]
    model = maxent.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert maxent.word_classes([b"aqq"]) == maxent.word_classes([b"bqq"])
    return model, common


def test_context_decides_between_words_of_one_class(spark):
    model, common = in_one_class(spark)
    pairs = ["red aqq", "red bqq", "blue bqq", "blue aqq"]
    docs = spark.createDataFrame([(i, f"{common} {p}") for i, p in enumerate(pairs)], "doc_id long, text string")
    s = [r["score"] for r in maxent.score(docs, model).orderBy("doc_id").collect()]
    assert s[0] > s[1] + 0.5 and s[2] > s[3] + 0.5


def test_words_of_a_class_share_one_in_every_context(spark):
    model, _ = in_one_class(spark)
    (cls,) = maxent.word_classes([b"aqq"])
    names = [w for w in ("aqq", "bqq", "red", "blue") if maxent.word_classes([w.encode()]) == cls]
    for before in ("red", "blue", "zzz"):
        t = maxent.Tokens.of(pa.array([f"{before} {w}" for w in [*names, "notseenqq"]]), model.own)
        p = 10 ** maxent.Decisions(model.tree, t).log10(model.cells)[t.place == 1]
        assert p.sum() == pytest.approx(1.0, rel=1e-6)


def test_without_weights_a_leaf_has_its_share_of_the_counts():
    rng = np.random.default_rng(1)
    n = 5000
    kind = np.sort(rng.integers(0, maxent.CLASSES, n)).astype(np.int32)
    h, c = rng.permutation(np.arange(1, n + 1)), rng.zipf(1.3, n).clip(max=10 ** 6)
    total = np.bincount(kind, c + 1, minlength=maxent.CLASSES) + 7.0
    tree = maxent.Tree.of(h, kind, c, total)
    ends, node, right = tree.paths(tree.leaves(h, kind), kind)
    p = np.where(right, 1, 0) - np.where(right, 1, -1) / (1 + np.exp(tree.logit[node].astype(float)))
    got = np.exp(np.bincount(np.repeat(np.arange(n), np.diff(ends)), np.log(p), minlength=n))
    inner = kind > maxent.OWN_CLASSES
    assert np.allclose(got[inner], ((c + 1) / total[kind])[inner], rtol=1e-4)
    assert (got[~inner] == 1).all()


def plain_draw(e, random):
    groups = e.reshape(len(e), -1, 8)
    upto = np.cumsum(groups.sum(axis=2), axis=1)
    at = random.random((len(e), 1), dtype=np.float32) * upto[:, -1:]
    group = np.minimum((upto <= at).sum(axis=1), 7)
    row = np.arange(len(e))
    inner = np.cumsum(groups[row, group], axis=1)
    rest = at[:, 0] - (upto[row, group] - inner[:, -1])
    return group * 8 + np.minimum((inner <= rest[:, None]).sum(axis=1), 7)


def weights_and_rows(n, scale=1.0):
    rng = np.random.default_rng(3)
    weights = (scale * rng.standard_normal((maxent._ROWS, maxent.CLASSES))).astype(np.float32)
    rows = rng.integers(0, maxent.BUCKETS, (maxent.KINDS, n)) + np.arange(maxent.KINDS)[:, None] * maxent.BUCKETS
    return weights, rows.astype(np.int32), rng.integers(0, maxent.CLASSES, n).astype(np.int32)


def test_a_draw_is_the_plain_one_and_cheap_beside_the_exponentials_it_draws_from():
    weights, rows, _ = weights_and_rows(8192)
    e = maxent.class_exponentials(weights, rows)
    assert (maxent.draw(e, np.random.default_rng(5)) == plain_draw(e, np.random.default_rng(5))).all()

    def seconds(f):
        best = math.inf
        for _ in range(9):
            t = time.thread_time()
            f()
            best = min(best, time.thread_time() - t)
        return best

    rng = np.random.default_rng(0)
    assert seconds(lambda: maxent.draw(e, rng)) < 0.28 * seconds(lambda: maxent.class_exponentials(weights, rows))


def test_steps_on_the_classes_match_plain_ones():
    weights, rows, cls = weights_and_rows(3000, 0.1)
    rows[0] = rows[0] % 7  # few rows, many tokens each
    trainer, want = maxent.Trainer(weights, 11), weights.copy()
    power, random = np.full((maxent._ROWS, 1), 1e-6, dtype=np.float32), np.random.default_rng(11)
    for a, b in ((0, 2000), (2000, 3000)):
        r, k = rows[:, a:b], cls[a:b]
        drawn = plain_draw(maxent.class_exponentials(want, r), random)
        seen, g = np.zeros(maxent._ROWS), np.zeros_like(weights)
        for x in [*r, np.full(b - a, maxent._ROWS - 1)]:
            np.add.at(seen, x, 1)
            np.add.at(g, (x, drawn), 1)
            np.add.at(g, (x, k), -1)
        used = seen > 0
        g[used] /= np.sqrt(seen[used])[:, None]
        power[used] += (g[used] ** 2).sum(axis=1)[:, None]
        want[used] -= maxent.RATE * g[used] / np.sqrt(power[used])
        trainer.step(r, k)
    assert np.allclose(trainer.weights, want, rtol=1e-5, atol=1e-6)
    untouched = (want == weights).all(axis=1)
    assert (trainer.weights == weights)[untouched].all() and untouched.any() and not trainer.gap.any()


def test_steps_on_the_decisions_match_plain_ones():
    rng = np.random.default_rng(4)
    trainer = maxent.Trainer(np.zeros((maxent._ROWS, maxent.CLASSES), np.float32), 0)
    cells, right = rng.integers(0, 500, (maxent.KINDS, 4000)) * 2000, rng.random(4000) < 0.3
    logit = rng.standard_normal(4000).astype(np.float32)
    want, power = np.zeros(maxent.CELLS), np.full(maxent.CELLS, maxent.CELL_PRIOR)
    for _ in range(3):
        gap = 1 / (1 + np.exp(-(logit + want[cells].sum(axis=0)))) - right
        g = np.zeros(maxent.CELLS)
        for c in cells:
            np.add.at(g, c, gap)
            np.add.at(power, c, maxent.KINDS * gap * gap)
        want -= g / power
        trainer.decide(cells, logit, right)
    assert np.allclose(trainer.cells, want, atol=1e-4) and trainer.cells.any()


def test_products_of_factors_are_the_exponentials():
    weights, rows, _ = weights_and_rows(5000, 3.0)
    factors = maxent.class_factors(weights)
    want = maxent.class_exponentials(weights, rows)
    assert np.allclose(maxent.class_products(factors, rows), want, rtol=1e-5)
    weights *= 0.3
    weights[3, 5], weights[rows[1, 0], 5], weights[4, 6] = 30, 12, -45  # logits beyond the safe range
    rows[0, :2] = 3, 4
    assert (maxent.class_exponentials(weights, rows)[:2] == np.exp(np.float32([[40], [-40]]))).any(axis=1).all()
    assert np.allclose(maxent.class_products(maxent.class_factors(weights), rows),
                       maxent.class_exponentials(weights, rows), rtol=1e-5)
    weights[3, 5] = 70  # products beyond the range of floats: scored by exponentials
    assert maxent.class_factors(weights) is None


def test_large_weights_are_scored_by_exponentials(spark):
    model, common = in_one_class(spark)
    docs = spark.createDataFrame([(1, f"{common} red aqq"), (2, None)], "doc_id long, text string")
    model.weights[7] = 90  # of no word here
    far = maxent.score(docs, model).orderBy("doc_id").toPandas()
    model.weights[7] = 0
    near = maxent.score(docs, model).orderBy("doc_id").toPandas()
    assert np.allclose(far.score, near.score, rtol=1e-6)


def test_classes_of_short_and_empty_words():
    names = [b"", b"a", b"\x00", b"\x00a", b"ab", b"xxab", b"\xc3\xa9", b"a\x00"]
    last = [int.from_bytes(w[-2:], "big") for w in names]
    want = [(x * int(maxent._MIX[0]) % 2 ** 64 >> 40) % (maxent.CLASSES - 1 - maxent.OWN_CLASSES) + 1
            + maxent.OWN_CLASSES for x in last]
    assert maxent.word_classes(names).tolist() == want and not len(maxent.word_classes([]))


def test_places_are_those_of_searchsorted():
    rng = np.random.default_rng(2)
    of, keys = np.sort(rng.integers(-50, 50, 40)), rng.integers(-60, 60, 300)
    assert (maxent.places(of, keys) == np.searchsorted(of, keys)).all()
    assert not len(maxent.places(of, keys[:0])) and not maxent.places(of[:0], keys).any()
