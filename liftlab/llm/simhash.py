"""SimHash near-duplicates by a binary trie self-join.

A text's fingerprint has the bits that are set in over half of the XXH64 hashes
(seed 42) of its word shingles. Distinct fingerprints form a binary trie; two
fingerprints link when at most ``max_bits`` bits differ. The join walks pairs
of trie nodes downwards together, adds up the differing bits on the way, and
drops a pair as soon as the sum exceeds the budget.

Distribution. Two fingerprints with at most k differing bits agree in at least
one of k + 1 segments. The trie is therefore built k + 1 times, each time with
another segment rotated to the top, and only node pairs without an error in
that top segment are followed: the segment's value names a unit of work that
holds all its fingerprints. A unit with more than ``unit_rows`` fingerprints is
split: its node pairs four levels down become units of their own (a node
with itself, or two nodes and their errors so far), again and again if need be.
Each task reports, for the links that it finds, only a forest (every linked
fingerprint with the smallest one it reaches there), so a dense group of n
fingerprints yields at most n rows a unit. Alternating large-star and small-star
rounds over these edges then give the components.

Defined cases. Null, empty and blank texts have fingerprint 0, which links like
any other. Texts with fewer words than a shingle have one shingle, the whole
sequence. Repeated rows and equal texts share a fingerprint and a component. A
null doc_id counts as no id: the component of rows without any id is null. An
empty table gives an empty result. Further columns are ignored by
``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlab.llm.common import fresh, stored, table

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints in one unit of the trie join.
UNIT_ROWS = 1 << 14
#: Trie levels by which a large unit is split at a time.
SPLIT_BITS = 4

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_RUN_BYTES = 1 << 22
_ROWS_AT_ONCE = 1 << 18


def word_runs(text: bytes, overlap: int) -> Iterator[list[bytes]]:
    """Lower-cased words of a text in lists that overlap by ``overlap`` words."""
    at, tail = 0, []
    while at < len(text):
        end = at + _RUN_BYTES
        blank = _BLANK.search(text, end) if end < len(text) else None
        end = blank.end() if blank else len(text)
        run = tail + text[at:end].lower().split()
        yield run
        tail, at = run[max(0, len(run) - overlap):], end


def shingle_hashes(text: bytes, n: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's n-word shingles, in runs of bounded size."""
    found, run = False, []
    for run in word_runs(text, n - 1):
        h = [xxhash.xxh64_intdigest(s, SEED)
             for s in map(b" ".join, zip(*(run[i:] for i in range(n))))]
        if h:
            found = True
            yield np.array(h, dtype=np.uint64)
    if run and not found:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(run), SEED)], dtype=np.uint64)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits


def fingerprints(texts: list[str | None], n: int = SHINGLE) -> np.ndarray:
    """SimHash of each text as unsigned 64-bit integers."""
    counts = np.zeros((len(texts), 64), dtype=np.int64)
    total = np.zeros(len(texts), dtype=np.int64)
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            starts = np.cumsum([0] + [len(h) for _, h in held[:-1]])
            bits = _bit_counts(np.concatenate([h for _, h in held]))
            sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            np.add.at(counts, [i for i, _ in held], sums)
        held, size = [], 0

    for i, text in enumerate(texts):
        for h in shingle_hashes((text or "").encode(), n):
            held.append((i, h))
            total[i] += len(h)
            size += len(h)
            if size >= _ROWS_AT_ONCE:
                flush()
    flush()
    set_bits = 2 * counts > total[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def with_fingerprint(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint as signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()),
                        ("fingerprint", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column(2).to_pylist(), n).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fingerprint long")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked value with the smallest value it reaches, roots left out."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(ids))
    while True:
        lo, hi = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = lo != hi
        if not open_.any():
            break
        np.minimum.at(label, hi[open_], lo[open_])
        while (label[label] != label).any():
            label = label[label]
    child = label != np.arange(len(ids))
    return ids[child], ids[label[child]]


class _Links:
    """Links found so far, reduced to a forest whenever they grow large."""

    def __init__(self) -> None:
        self.u, self.v, self.size = [], [], 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.u.append(u)
        self.v.append(v)
        self.size += len(u)
        if self.size > 4 * _ROWS_AT_ONCE:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.size:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        u, v = forest(np.concatenate(self.u), np.concatenate(self.v))
        self.u, self.v, self.size = [u], [v], len(u)
        return u, v


def trie_links(keys: np.ndarray, pairs: np.ndarray, depth: np.ndarray, max_bits: int,
               links: _Links) -> None:
    """Walk node pairs down the trie and report keys with few differing bits.

    ``keys``: unsigned 64-bit keys, sorted within every node. ``pairs``: one
    row (from, to, from, to, differing bits so far) per pair of nodes, which
    are ranges of ``keys``; a node paired with itself stands for its inner
    pairs. ``depth``: bits that all keys of the pair's nodes share by node.
    """
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
        if d not in ones:
            bit = (keys >> np.uint64(63 - d)) & np.uint64(1)
            ones[d] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        return hi - (ones[d][hi] - ones[d][lo])

    stack = [(int(d), pairs[depth == d]) for d in np.unique(depth)]
    while stack:
        d, p = stack.pop()
        if len(p) > _ROWS_AT_ONCE:
            half = len(p) // 2
            stack += [(d, p[:half]), (d, p[half:])]
            continue
        p = p[(p[:, 1] > p[:, 0]) & (p[:, 3] > p[:, 2]) & (p[:, 4] <= max_bits)]
        same = p[:, 0] == p[:, 2]
        p = p[~(same & (p[:, 1] - p[:, 0] == 1))]
        single = (p[:, 1] - p[:, 0] == 1) & (p[:, 3] - p[:, 2] == 1)
        a, b = keys[p[single, 0]], keys[p[single, 2]]
        near = np.bitwise_count(a ^ b) <= max_bits
        if near.any():
            links.add(a[near], b[near])
        p = p[~single]
        if not len(p) or d > 63:
            continue
        alo, ahi, blo, bhi, err = p.T
        amid, bmid = split(alo, ahi, d), split(blo, bhi, d)
        cross = alo != blo
        children = [np.stack([alo, amid, blo, bmid, err], 1),
                    np.stack([amid, ahi, bmid, bhi, err], 1),
                    np.stack([alo, amid, bmid, bhi, err + 1], 1),
                    np.stack([amid, ahi, blo, bmid, err + 1], 1)[cross]]
        stack.append((d + 1, np.concatenate(children)))


def _unit_links(rows: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """Forest of the links in whole units (unit, turn, side, depth, err, key)."""
    key = rows["key"].to_numpy(np.int64).view(np.uint64)
    unit, side = rows["unit"].to_numpy(np.int64), rows["side"].to_numpy(np.int64)
    turn = rows["turn"].to_numpy(np.int64)
    order = np.lexsort((key, side, unit, turn))
    key, unit, side, turn = key[order], unit[order], side[order], turn[order]
    depth, err = rows["depth"].to_numpy(np.int64)[order], rows["err"].to_numpy(np.int64)[order]
    new = np.ones(len(key), bool)
    new[1:] = (unit[1:] != unit[:-1]) | (side[1:] != side[:-1]) | (turn[1:] != turn[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(key))
    alone = np.flatnonzero((side[lo] == 0) & (hi - lo > 1))
    left = np.flatnonzero((side[lo[:-1]] == 1) & (side[lo[1:]] == 2)
                          & (unit[lo[:-1]] == unit[lo[1:]]) & (turn[lo[:-1]] == turn[lo[1:]]))
    own = np.stack([lo[alone], hi[alone], lo[alone], hi[alone], err[lo[alone]]], 1)
    two = np.stack([lo[left], hi[left], lo[left + 1], hi[left + 1], err[lo[left]]], 1)
    pairs = np.concatenate([own, two])
    at, by = depth[pairs[:, 0]], turn[pairs[:, 0]]
    out = []
    for t in np.unique(by):
        links = _Links()
        trie_links(key, pairs[by == t], at[by == t], max_bits, links)
        u, v = links.reduce()
        # Turn the keys back into fingerprints.
        t = np.uint64(t)
        back = (lambda x: x) if t == 0 else (lambda x: (x >> t) | (x << (np.uint64(64) - t)))
        out += [(back(u), back(v))]
    links = _Links()
    for u, v in out:
        links.add(u, v)
    u, v = links.reduce()
    return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})


def _whole_units(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= _ROWS_AT_ONCE:  # the last unit may go on in the next batch
                rows = pd.concat(held)
                last = rows["unit"].to_numpy() == rows["unit"].iloc[-1]
                held, size = [rows[last]], int(last.sum())
                yield _unit_links(rows[~last], max_bits)
        if held:
            yield _unit_links(pd.concat(held), max_bits)
    return run


def _units(nodes: DataFrame, max_bits: int) -> DataFrame:
    """One row per fingerprint and segment: the trie with that segment on top."""
    k = max_bits + 1
    edges = [64 * i // k for i in range(k + 1)]
    turns = [F.struct(F.lit(a).alias("turn"), F.lit(b - a).alias("width"))
             for a, b in zip(edges, edges[1:])]
    rows = nodes.select("fingerprint", F.explode(F.array(*turns)).alias("t"))
    key = F.expr("(fingerprint << t.turn) | (case when t.turn = 0 then 0 "
                 "else shiftrightunsigned(fingerprint, 64 - t.turn) end)")
    rows = rows.select(F.col("t.turn").alias("turn"), F.col("t.width").alias("depth"),
                       key.alias("key"))
    return rows.select(F.expr("shiftrightunsigned(key, 64 - depth) * 64 + turn").alias("unit"),
                       "turn", F.lit(0).alias("side"), "depth", F.lit(0).alias("err"), "key")


def _split(heavy: DataFrame, max_bits: int) -> DataFrame:
    """Node pairs SPLIT_BITS further down of every unit in ``heavy``."""
    n = 1 << SPLIT_BITS
    mine = F.expr(f"shiftrightunsigned(key, 64 - depth - {SPLIT_BITS}) & {n - 1}")
    h = heavy.withColumn("_p", mine.cast("int")).withColumn(
        "_q", F.explode(F.array(*[F.lit(q) for q in range(n)])))
    off = F.bit_count(F.col("_p").bitwiseXOR(F.col("_q")))
    h = h.withColumn("err", (F.col("err") + off).cast("int")).where(F.col("err") <= max_bits)
    # In a unit of one node, the pair {p, q} has one unit; of two nodes, (p, q) and (q, p) differ.
    lower = F.least("_p", "_q")
    upper = F.greatest("_p", "_q")
    first = F.when(F.col("side") == 0, lower).when(F.col("side") == 1, F.col("_p")).otherwise(F.col("_q"))
    second = F.when(F.col("side") == 0, upper).when(F.col("side") == 1, F.col("_q")).otherwise(F.col("_p"))
    side = F.when(F.col("side") != 0, F.col("side")).when(F.col("_p") == F.col("_q"), 0).when(
        F.col("_p") < F.col("_q"), 1).otherwise(2)
    return h.select(F.xxhash64("unit", first, second).alias("unit"), "turn",
                    side.cast("int").alias("side"),
                    (F.col("depth") + SPLIT_BITS).cast("int").alias("depth"), "err", "key")


def links_of(nodes: DataFrame, max_bits: int = MAX_BITS, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """(fingerprint) -> edges (u, v) whose components are those of all links."""
    rows, out = stored(_units(nodes, max_bits), "simhash-units"), []
    while True:
        counts = rows.groupBy("unit", "turn").agg(
            F.count(F.lit(1)).alias("n"), F.min("depth").alias("d"),
            F.count_if(F.col("side") != 2).alias("left"),
            F.count_if(F.col("side") != 1).alias("right"))
        both = (F.col("left") > 0) & (F.col("right") > 0)
        large = stored(counts.where((F.col("n") > unit_rows) & both
                                    & (F.col("d") <= 64 - SPLIT_BITS)).select("unit", "turn"),
                       "simhash-large")
        if large.isEmpty():
            out.append(rows)
            break
        out.append(rows.join(large, ["unit", "turn"], "left_anti"))
        rows = stored(_split(rows.join(large, ["unit", "turn"]), max_bits), "simhash-units")
    found = [r.select("unit", "turn", "side", "depth", "err", "key").repartition("unit")
             .sortWithinPartitions("unit").mapInPandas(_whole_units(max_bits), "u long, v long")
             for r in out]
    edges = found[0]
    for f in found[1:]:
        edges = edges.unionByName(f)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) -> (u, v): every node but the smallest, with the smallest it reaches.

    Alternating large-star and small-star rounds; each replaces a node's
    edges by edges to its smallest neighbour. The minima are partial
    aggregates; the join back to a node with many edges is one that adaptive
    execution can split.
    """
    def ordered(e: DataFrame) -> DataFrame:
        return (e.where("u <> v").select(F.greatest("u", "v").alias("u"),
                                         F.least("u", "v").alias("v")).distinct())

    e = stored(ordered(edges), "components")
    while True:
        roles = (e.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
                 .unionAll(e.select("v", F.lit(0), F.lit(1))))
        open_ = roles.groupBy("x").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where(
            "c > 1 or (c > 0 and p > 0)")
        if open_.isEmpty():
            return e
        both = e.unionAll(e.select(F.col("v"), F.col("u")).toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = ordered(both.where("v > u").join(low, "u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v")
        e = stored(ordered(small), "components")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    unit_rows: int = UNIT_ROWS) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_hash, fingerprint, component_id), one row per input row."""
    fps = stored(with_fingerprint(docs, shingle), "simhash")
    nodes = stored(fps.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    star = components(links_of(nodes, max_bits, unit_rows))
    rooted = nodes.join(star, nodes["fingerprint"] == star["u"], "left").select(
        "fingerprint", "least", F.coalesce("v", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(least, "root").select("fingerprint", "component_id")
    return fps.join(labels, "fingerprint").select("doc_id", "text_hash", "fingerprint",
                                                  "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Keep one document of each component: the one with the smallest doc_id.

    Ties (repeated ids) go to the smaller text hash, and of repeated rows one
    stays. In a component of rows without any id, one row stays as well.
    """
    found = stored(near_duplicates(docs, shingle, max_bits), "simhash-found")
    own, id_, hash_ = fresh(docs.columns, "_text_hash", "_id", "_hash")
    # Rows without an id cannot be told apart by it: their component is their fingerprint's.
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")))
    best = found.groupBy(group.alias("g")).agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")).select(
        F.col("best.doc_id").alias(id_), F.col("best.text_hash").alias(hash_))
    rows = docs.withColumn(own, F.xxhash64("text"))
    match = rows["doc_id"].eqNullSafe(best[id_]) & (rows[own] == best[hash_])
    kept = rows.join(best, match, "left_semi")
    copies = found.groupBy("doc_id", "text_hash").count().where("count > 1").select(
        F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    match = kept["doc_id"].eqNullSafe(copies[id_]) & (kept[own] == copies[hash_])
    once = kept.join(copies, match, "left_anti")
    repeated = kept.join(copies, match, "left_semi").dropDuplicates(["doc_id", own])
    return once.unionByName(repeated).drop(own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                        "component_id")
