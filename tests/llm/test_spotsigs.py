"""SpotSigs against a plain version, on a small table and on odd rows."""

import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F

from liftlab.llm import spotsigs

SF = "/root/testdata/sf0.001"


def spark_hashes(spark, rows):
    """XXH64 of tuples of words as Spark computes it."""
    rows = sorted(set(rows), key=repr)
    width = max(map(len, rows), default=1)
    df = spark.createDataFrame([(list(r) + [None] * (width - len(r)),) for r in rows], "w array<string>")
    got = df.select(F.xxhash64(*[F.get("w", F.lit(i)) for i in range(width)])).collect()
    return {r: g[0] for r, g in zip(rows, got)}


def plain_spots(text, sampled):
    w = [x for x in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if x]
    common = set(spotsigs.COMMON_WORDS)
    out = set()
    for i, x in enumerate(w):
        if x in common or sampled(x):
            chain = [y for y in w[i + 1:] if y not in common][:spotsigs.CHAIN]
            if chain:
                out.add((x, *chain))
    return out or {tuple(w[i:i + spotsigs.CHAIN + 1]) for i in range(len(w))}


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check(spark, rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    every = {(x,) for _, t in rows for x in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if x}
    h = spark_hashes(spark, every) if every else {}
    sampled = lambda x: h.get((x,), 1) % spotsigs.SAMPLED == 0
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    marks = {}
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1] or ""
        t = t or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        r, s, e = by_id[d], plain_spots(t, sampled), plain_spots(edited, sampled)
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["n_spots"] == len(s)
        # A word of the edited text may be cut: its sampling is unknown to the plain version here.
        assert r["near_edited"] == pytest.approx(jaccard(s, e), abs=0.05)
        assert r["near_next"] == pytest.approx(jaccard(s, plain_spots(nxt, sampled)))
        assert marks.setdefault(frozenset(s), r["fingerprint"]) == r["fingerprint"]
    assert len(set(marks.values())) == len(marks)


@pytest.mark.parametrize("buckets", [1, 8])
def test_whole_small_table(spark, buckets, monkeypatch):
    monkeypatch.setattr(spotsigs.with_next, "__defaults__", (buckets,))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = spotsigs.query(spark, SF).collect()
    check(spark, rows, got)
    equal = {}
    for d, t in rows:
        equal.setdefault(t, set()).add(next(r["fingerprint"] for r in got if r["doc_id"] == d))
    assert all(len(x) == 1 for x in equal.values())


def run(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"signature": F.lit("clash"), "bucket": F.lit(1), "n_chars": F.lit(2)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return spotsigs.query(spark, str(tmp_path)).collect()


def test_odd_rows(spark, tmp_path):
    rows = [(5, None), (2, ""), (9, "one"), (3, "The cat sat on the mat with the dog"), (4, "the the the"),
            (7, "ö漢 字🙂 der Hund und die Katze"), (8, "x " * 100_000), (1, "%%% &&&"), (10, "a"), (None, "of no id at all")]
    check(spark, rows, run(spark, rows, tmp_path))


def test_one_row_and_repeated_rows(spark, tmp_path):
    got = run(spark, [(1, "alone in the world of words")], tmp_path / "one")
    assert got[0]["near_next"] == 1.0 and len(got) == 1
    got = run(spark, [(1, "same the text"), (1, "same the text"), (1, "other of text"), (2, "last by far")], tmp_path / "two")
    assert len(got) == 4 and sorted(r["near_next"] for r in got)[-1] == 1.0
    assert run(spark, [], tmp_path / "none") == []


def test_pruned_likeness(spark):
    sets = [list(range(n)) for n in (0, 1, 4, 5, 8, 10, 30)] + [list(range(5, 15))]
    df = spark.createDataFrame([(a, b) for a in sets for b in sets], "a array<long>, b array<long>")
    for r in df.select("a", "b", spotsigs.likeness("a", "b").alias("x"), spotsigs.likeness("a", "b", 0.8).alias("y")).collect():
        want = jaccard(set(r["a"]), set(r["b"]))
        assert r["x"] == pytest.approx(want)
        assert r["y"] == pytest.approx(want if want >= 0.8 else 0.0)


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_near_signatures_are_all_pairs_of_that_likeness(spark, threshold):
    rnd = random.Random(7)
    sets = [frozenset(rnd.sample(range(40), rnd.randint(1, 25))) for _ in range(60)]
    sets += [s - {min(s)} for s in sets[:40]] + [s | {100} for s in sets[20:50]] + sets[:10] + [frozenset()] * 3
    rows = spark.createDataFrame([(sorted(s),) for s in sets], "signature array<long>")
    marks = {r["f"]: frozenset(r["signature"]) for r in rows.select(
        "signature", spotsigs.fingerprint(F.col("signature")).alias("f")).collect()}
    got = [(r[0], r[1], r[2]) for r in spotsigs.near_signatures(rows, threshold).collect()]
    want = {(a, b): j for a in marks for b in marks if a < b and (j := jaccard(marks[a], marks[b])) >= threshold}
    assert len(got) == len(want) > 30
    for a, b, j in got:
        assert j == pytest.approx(want[a, b])


def test_sizes_at_the_bound_are_in_neighbouring_classes(spark):
    rows = spark.createDataFrame([(list(range(n)),) for n in (10, 100, 1000, 10_000)], "signature array<long>")
    assert spotsigs.near_signatures(rows, 0.1).count() == 3


def test_no_python_in_the_plan(spark):
    plan = spotsigs.query(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
