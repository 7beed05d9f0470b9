"""Prefix trie against a plain dictionary of prefixes; packing; long and shared conversations; odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftlab.llm import turntrie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    """Rows (conv_id, turn, role, text) -> conv_id -> list of (role, text), as the contract rebuilds them."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(convs):
    """conv_id -> turns -> rows of COLUMNS."""
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in cs if len(convs[c]) == len(p))
        out.append((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), kids[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(df, **kw):
    """The registered query's steps over any table."""
    rows, spans = turntrie.in_order(turntrie.turn_digests(df))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return turntrie.prefix_nodes(turntrie.grafted(rows, spans, F.col("conv_id") - F.col("conv_id") % 100, taken, 5), **kw)


def collected(df):
    assert df.columns == COLUMNS and [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def chats(n, seed, turns=6, texts=4):
    """Few texts: many conversations share prefixes, some are copies of one another."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        own = rng.choice([range(0), range(turns), range(rng.randrange(turns + 1))])
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", "hello" if t < 2 else "x" * rng.randrange(texts)) for t in own]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [1 << 15, 60, 9, 1])
def test_against_a_dictionary_of_prefixes(spark, shard_turns):
    rows = chats(150, 1)
    assert collected(trie(frame(spark, rows).repartition(5), shard_turns=shard_turns)) == plain(rebuilt(rows))


@pytest.mark.parametrize("shard_turns", [1 << 15, 40])
def test_long_conversations_go_on_below_their_segments(spark, shard_turns):
    rows = chats(60, 2, turns=30, texts=2)
    # Copies of one long conversation, one that goes on, and one that ends where a segment ends.
    long = [("user", f"turn {t}") for t in range(80)]
    for c, n in ((300, 80), (400, 80), (500, 49), (600, 63), (700, 14)):
        rows += [(c, t, *long[t]) for t in range(n)]
    assert collected(trie(frame(spark, rows), shard_turns=shard_turns, segment=7)) == plain(rebuilt(rows))


def test_registered_query_is_in_the_oracle(spark):
    from liftlab.llm import queries
    assert queries.queries()["op12_double_array_trie"] is turntrie.query and "op12_double_array_trie" in queries.oracle_sql()


def test_a_third_of_all_conversations_alike(spark):
    rows = [(c, t, "user", f"{t}" if c % 3 == 0 else f"{t} {c % 11}") for c in range(600) for t in range(4)]
    got = collected(trie(frame(spark, rows), shard_turns=200))
    assert got == plain(rebuilt(rows))


def test_salted_names_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "BROADCAST_NODES", -1)
    rows = chats(80, 3)
    assert collected(trie(frame(spark, rows), shard_turns=20)) == plain(rebuilt(rows))


def test_ends_stream_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "END_BLOCK", 3)
    ids = list(range(-10, 40)) + [10_000, 99, 1 << 40]
    df = spark.createDataFrame([(bytearray(b"k"), i) for i in ids] + [(bytearray(b"l"), 5)], "key binary, conv_id long").repartition(6)
    got = {bytes(r["key"]): r["end"] for r in turntrie.end_hashes(df).collect()}
    assert got == {b"k": hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), b"l": hashlib.sha256(b"5").hexdigest()}


@pytest.mark.parametrize("seed", range(5))
def test_double_array(seed):
    """Every child is found at BASE + id with its parent in CHECK, and no other slot answers."""
    rng = np.random.default_rng(seed)
    roots, parent, label = 2, [], []
    total, queue = roots, [0, 1]
    while queue and total < 400:
        p = queue.pop(0)
        kids = rng.choice(300, size=int(rng.choice([0, 1, 1, 2, 9, 60])), replace=False)
        parent += [p] * len(kids)
        label += kids.tolist()
        queue += range(total, total + len(kids))
        total += len(kids)
    base, check = turntrie.pack(np.array(parent, np.int64), np.array(label, np.int64), roots)
    slot = dict(enumerate(range(roots)))
    for i, (p, a) in enumerate(zip(parent, label)):
        slot[roots + i] = int(base[slot[p]] + a)
        assert check[slot[roots + i]] == slot[p]
    assert len(set(slot.values())) == total == (check >= 0).sum() + roots
    have = defaultdict(set)
    for p, a in zip(parent, label):
        have[p].add(a)
    for v, s in slot.items():
        if v in have:  # a leaf's base is never followed
            places = base[s] + np.arange(300)
            inside = (places >= 0) & (places < len(check))
            assert set(np.flatnonzero(inside)[check[places[inside]] == s]) == have[v]
    assert len(base) <= 5 * total


def test_neighbouring_ids_are_packed_without_gaps():
    parent = np.repeat([0, 1, 2, 3, 9], [5, 3, 1, 4, 1])
    base, check = turntrie.pack(parent, np.concatenate([np.arange(5), np.arange(3), [7], np.arange(4, 8), [2]]), 1)
    assert len(base) == 1 + len(parent) and (check[1:] >= 0).all()


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, None, "", ""), (1, 0, "user", "é" * 10), (1, 0, "user", "é" * 10),
            (1, 0, "assistant", "tie"), (100, 0, "a", "b:c"), (101, 5, "a:", "bc"), (102, -1, "user", "x" * 2_000_000),
            (-5, 0, "user", "negative"), (-105, 3, "user", "negative"), (-100, 1, None, "base")]
    rows += [(7, 1, "user", "again")] * 40  # repeated rows are turns
    df = frame(spark, rows).withColumns({n: F.lit(1) for n in ("code", "size", "row", "pos", "part", "key", "segment")})
    want = plain(rebuilt(rows))
    assert collected(trie(df)) == want
    assert collected(trie(df.repartition(6), shard_turns=5)) == want
    assert collected(trie(df.limit(0))) == []
