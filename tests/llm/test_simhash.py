"""SimHash near-duplicates against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from liftlab.llm import simhash


def plain_fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= bits:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(fps))]


TEXTS = ["The quick brown fox jumps over the lazy dog", "the QUICK brown fox jumps over the lazy dog",
         "", None, "   \t\n", "one", "ONE", "two words", "Ünï cödé Ä words here", "Ünï cödé ä words here",
         "a b c " * 500, "a\x0bb\x0cc", "a b c", "x" * 100_000, "word " * 60_000]


def test_fingerprints_match_the_definition():
    got = simhash.fingerprints(TEXTS)
    assert [int(x) for x in got] == [plain_fingerprint(t) for t in TEXTS]


def test_runs_of_a_long_text_give_the_same_fingerprint(monkeypatch):
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(5000))
    monkeypatch.setattr(simhash, "_RUN_BYTES", 50)
    monkeypatch.setattr(simhash, "_ROWS_AT_ONCE", 37)
    assert int(simhash.fingerprints([text])[0]) == plain_fingerprint(text)
    assert int(simhash.fingerprints(["a b"])[0]) == plain_fingerprint("a b")


def clusters(seed, n=40, spread=6):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        centre = rnd.getrandbits(64)
        for _ in range(spread):
            out.append(centre)
            for b in rnd.sample(range(64), rnd.randint(1, 3)):
                centre ^= 1 << b
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("unit_rows", [1 << 14, 3])
def test_components_match_brute_force(spark, unit_rows):
    fps = sorted(set(clusters(1) + [0, 1, 3, 7, 15, 31, (1 << 64) - 1]
                     + [0xABC << 52 | sum(1 << b for b in c) for c in itertools.combinations(range(12), 2)]))
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fingerprint long")
    star = simhash.components(simhash.links_of(nodes, 3, unit_rows))
    root = {r["u"]: r["v"] for r in star.collect()}
    got = [root.get(signed(f), signed(f)) for f in fps]
    want = plain_components(fps)
    groups = {}
    for g, w in zip(got, want):
        groups.setdefault(w, set()).add(g)
    assert all(len(s) == 1 for s in groups.values())
    assert len({next(iter(s)) for s in groups.values()}) == len(groups)


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_other_error_budgets(spark, bits):
    fps = sorted(set(clusters(bits, 15, 5)))
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fingerprint long")
    root = {r["u"]: r["v"] for r in simhash.components(simhash.links_of(nodes, bits)).collect()}
    got = [root.get(signed(f), signed(f)) for f in fps]
    want = plain_components(fps, bits)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_a_dense_group_yields_a_forest_only():
    keys = np.array(sorted(sum(1 << b for b in c) for c in itertools.combinations(range(40), 2)),
                    dtype=np.uint64)
    links = simhash._Links()
    pairs = np.array([[0, len(keys), 0, len(keys), 0]])
    simhash.trie_links(keys, pairs, np.array([0]), 3, links)
    u, v = links.reduce()
    assert len(u) == len(keys) - 1 and set(v) == {keys[0]}


def test_documents_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "alpha beta gamma delta", "x"), (2, "Alpha beta gamma delta", "y"), (3, None, None),
            (4, "", "z"), (None, "something else entirely here", "n"),
            (None, "something else entirely here", "n"), (5, "unique text of its own kind", "u"),
            (5, "unique text of its own kind", "u"), (7, "third text that nobody repeats", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, unit string").withColumns(
        {"fingerprint": F.lit("clash"), "u": F.lit(1), "component_id": F.lit(9), "_id": F.lit(0), "_text_hash": F.lit(0)})
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (None, None), (5, 5), (7, 7)}
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [
        (False, 1), (False, 3), (False, 5), (False, 7), (True, None)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.deduplicate(docs).count() == 0
