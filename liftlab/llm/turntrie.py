"""Trie of conversation prefixes, by double arrays over shards of sorted conversations.

* Turns become digests (the first 16 bytes of SHA-256 over role and text), get their
  place by one range sort, and are gathered per conversation into rows of at most
  SEGMENT turns. Equal rows are counted once (map-side first).
* Shards. The rows are range-sorted by their turns, so each shard holds neighbouring
  prefixes: a first turn that a third of all conversations share is spread over as many shards as
  its rows need. In a shard turns get dense ids, and the shard's trie is packed into one double array: node s
  has its child by turn id a at slot BASE[s] + a if CHECK there is s. Walking all
  rows through BASE and CHECK gives the members of every node.
* Upper nodes. Only prefixes of a shard's first and last row can go on in other shards. Every other node is
  complete and is returned. Those two paths, with what their nodes have gathered, are the rows of the next
  round, which walks them in the same way; rounds end when one shard holds all
  paths (two rows a shard, so two or three rounds). Their nodes merge the
  aggregates of all shards.
* Conversations longer than SEGMENT turns go on in a trie below the node where their segment
  ends. These tries are walked from the deepest up, and hand their roots' totals to that node.

Sums over subtrees (leaves, saved code points) are gathered from the deepest nodes up.
The hash over a node's conv_ids is a stream by definition: ids are joined in sorted blocks of at most
END_BLOCK, and a task that holds one block at a time hashes a node's blocks in order.

Defined cases. Null role or text: empty. Null turn: first. Turns that tie: by
role, then by digest; repeated rows are turns of their own. Rows without a conv_id belong to no
conversation and take no part. Turns of any length: only digest and length are
moved. A conversation without turns is a member of the root alone. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftlab.llm.common import shuffle_partitions, stored, table

CODE_BYTES = 16
SEGMENT = 1024
#: Turns and rows in one double array, about.
SHARD_TURNS = 1 << 15
#: Rows in a shard at least, so that every round has far fewer rows than the last.
SHARD_ROWS = 8
END_BLOCK = 4096
#: Merged upper nodes are broadcast up to this many (some 100 bytes each), else joined with salt.
BROADCAST_NODES = 100_000
SALT = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()
NOBODY = np.iinfo(np.int64).max

PATH = ("context binary, codes binary, sizes array<long>, counts array<long>, firsts array<long>, "
        "kids array<long>, leaves array<long>, saves array<long>, ends array<string>")
NODE = ("kind int, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, end string")
NODE_ROW, PATH_ROW, ROOT_ROW = 0, 1, 2


# Rows of turns

def turn_digests(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """Stored, narrow (conv_id, turn, role, code, size, row) of every turn."""
    r = F.coalesce(F.col(role).cast("string"), F.lit(""))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)
    return stored(conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"),
        F.substring(F.sha2(whole, 256), 1, 2 * CODE_BYTES).alias("code"),
        F.length(t).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")), "trie-turns")


def in_order(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (part, conv_id, at, code, size) and spans (part, conv_id, lo, before, n).

    A turn's place in its conversation is ``at - lo + before``. The sort key ends with the row's
    number, so even equal rows are split over partitions.
    """
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "code", "row"]
    rows = turns.repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    rows = stored(rows.select("conv_id", "code", "size", F.monotonically_increasing_id().alias("at")), "trie-order")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    spans = rows.groupBy("part", "conv_id").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part")
    return rows, stored(spans.withColumn("before", F.sum("n").over(earlier) - F.col("n")), "trie-spans")


def grafted(rows: DataFrame, spans: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """(conv_id, pos, code, size): every conversation opens with the first ``taken`` (of at most
    ``most``) turns of conversation ``base`` and goes on with its own after its first ``taken``.

    A row with pos -1 stands for each conversation, turns or none.
    """
    def placed(of: DataFrame, at: DataFrame) -> DataFrame:
        return of.join(at, ["part", "conv_id"]).withColumn("pos", F.col("at") - F.col("lo") + F.col("before"))

    convs = spans.select("conv_id").distinct().withColumns({"base": base, "taken": taken})
    heads = placed(rows, spans.where(F.col("before") < most)).where(F.col("pos") < most).select(
        F.col("conv_id").alias("base"), "pos", "code", "size")
    opening = stored(convs.join(heads, "base").where(F.col("pos") < F.col("taken")).select(
        "conv_id", "pos", "code", "size"), "trie-openings")
    got = opening.groupBy("conv_id").agg(F.count(F.lit(1)).alias("got"))
    shifted = spans.join(got, "conv_id", "left").withColumn("got", F.coalesce("got", F.lit(0))).withColumn(
        "taken", taken)
    own = placed(rows, shifted).where(F.col("pos") >= F.col("taken")).select(
        "conv_id", (F.col("pos") - F.col("taken") + F.col("got")).alias("pos"), "code", "size")
    none = convs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("code"),
                        F.lit(None).cast("long").alias("size"))
    return own.unionByName(opening).unionByName(none)


# Sequences

def _sha(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def _contexts(segments: pd.DataFrame) -> pd.DataFrame:
    """Key of the node below which each segment of a conversation goes on."""
    segments, context, out = segments.sort_values("segment"), b"", []
    for digest in segments["digest"]:
        out.append(context)
        context = hashlib.sha256(context + digest).digest()
    return pd.DataFrame({"conv_id": segments["conv_id"], "segment": segments["segment"], "context": out})


def sequences(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Stored (conv_id, segment, last, context, key, codes, sizes) of conversations given as
    (conv_id, pos, code, size). ``key`` names the node where the segment ends."""
    held = F.when(F.col("pos") >= 0, F.struct("pos", "code", "size"))
    part = F.greatest(F.lit(0), F.floor(F.col("pos") / segment)).cast("int")
    rows = turns.groupBy("conv_id", part.alias("segment")).agg(F.sort_array(F.collect_list(held)).alias("t"))
    codes = F.unhex(F.array_join(F.col("t.code"), ""))
    rows = stored(rows.select("conv_id", "segment", codes.alias("codes"), F.col("t.size").alias("sizes")),
                  "trie-segments")
    if not rows.agg(F.max("segment")).first()[0]:
        rows = rows.withColumns({"last": F.lit(True), "context": F.lit(b"")})
    else:
        ends = rows.groupBy("conv_id").agg(F.max("segment").alias("end"))
        long = rows.join(ends.where("end > 0"), "conv_id").select("conv_id", "segment", _sha(F.col("codes")).alias("digest"))
        contexts = long.groupBy("conv_id").applyInPandas(_contexts, "conv_id long, segment int, context binary")
        rows = (rows.join(ends, "conv_id").join(contexts, ["conv_id", "segment"], "left")
                .withColumns({"last": F.col("segment") == F.col("end"),
                              "context": F.coalesce("context", F.lit(b""))}).drop("end"))
    key = F.when(F.length("codes") == 0, F.col("context")).otherwise(
        _sha(F.concat("context", _sha(F.col("codes")))))
    return stored(rows.withColumn("key", key), "trie-sequences")


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ids) in order -> (key, end): one running hash, whatever the number of blocks."""
    held, running = None, None
    for b in batches:
        keys, out = [], []
        for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if key == held:
                running.update(b",")
            else:
                if running:
                    keys.append(held)
                    out.append(running.hexdigest())
                held, running = key, hashlib.sha256()
            running.update(ids.encode())
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["key", "end"])
    if running:
        yield pa.record_batch([pa.array([held], pa.binary()), pa.array([running.hexdigest()])], names=["key", "end"])


def end_hashes(members: DataFrame) -> DataFrame:
    """(key, conv_id) -> (key, end): SHA-256 of the ids, ascending, comma-joined."""
    block = F.floor(F.col("conv_id") / END_BLOCK)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = members.groupBy("key", block.alias("block")).agg(ids.alias("ids"))
    parts = shuffle_partitions(members.sparkSession)
    return blocks.repartition(parts, "key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(
        _hash_ends, "key binary, end string")


# Double arrays

def pack(parent: np.ndarray, label: np.ndarray, roots: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and CHECK of a trie. Nodes 0 to roots - 1 have no parent and keep these numbers as slots;
    node roots + i hangs below parent[i] by label[i]; siblings follow each other."""
    n = roots + len(parent)
    fan = np.bincount(parent, minlength=n) if n else np.zeros(0, np.int64)
    first = np.searchsorted(parent, np.arange(n))
    used = np.zeros(2 * n + int(label.max(initial=0)) + 2, bool)
    used[:roots] = True
    at = np.zeros(n, np.int64)  # base of each node, by number
    start = roots
    for p in np.flatnonzero(fan > 1)[np.argsort(-fan[fan > 1], kind="stable")].tolist():
        labels = np.sort(label[first[p]:first[p] + fan[p]])
        far = labels - labels[0]
        if len(used) < start + far[-1] + n + 2:
            used = np.concatenate([used, np.zeros(len(used) + int(far[-1]), bool)])
        look, step = start, max(1, 4096 // len(far))
        while True:  # first fit over the free slots
            free = look + np.flatnonzero(~used[look:len(used) - far[-1]])[:step]
            if not len(free):
                used = np.concatenate([used, np.zeros(len(used), bool)])
                continue
            fits = np.flatnonzero(~used[free[:, None] + far].any(axis=1))
            if len(fits):
                break
            look = int(free[-1]) + 1
        at[p] = free[fits[0]] - labels[0]
        used[free[fits[0]] + far] = True
        start = start + int(np.argmin(used[start:]))
    alone = np.flatnonzero(fan == 1)
    holes = np.flatnonzero(~used)[:len(alone)]
    at[alone] = holes - label[first[alone]]
    slot = np.concatenate([np.arange(roots), at[parent] + label])
    base = np.zeros(int(slot.max(initial=-1)) + 1, np.int64)
    check = np.full(len(base), -1, np.int64)
    base[slot] = at
    check[slot[roots:]] = slot[parent]
    return base, check


def _lists(flat: np.ndarray | pa.Array, lengths: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)),
                                    flat if isinstance(flat, pa.Array) else pa.array(flat))


class Shard:
    """The trie of sorted paths (columns of PATH), as a double array with one slot per node."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        self.context = rows.column(0).to_pylist()
        codes = rows.column(1).to_pylist()
        self.codes, n = codes, len(codes)
        self.m = m = np.array([len(c) // CODE_BYTES for c in codes], np.int64)
        sizes = rows.column(2).flatten().to_numpy()
        values = [rows.column(i).flatten().to_numpy() for i in range(3, 8)]
        self.ends = rows.column(8).flatten()
        turns = pa.Array.from_buffers(pa.binary(CODE_BYTES), int(m.sum()), [None, pa.py_buffer(b"".join(codes))])
        starts = np.cumsum(m) - m
        row = np.repeat(np.arange(n), m)
        depth = np.arange(len(row)) - starts[row]
        by_depth = np.argsort(depth, kind="stable")
        self.levels = np.searchsorted(depth[by_depth], np.arange(int(m.max(initial=0)) + 1))
        row, size = row[by_depth], sizes[by_depth]
        # Dense ids by first appearance, depth by depth: siblings are close together.
        label = turns.take(pa.array(by_depth)).dictionary_encode().indices.to_numpy().astype(np.int64)
        new = np.array([i == 0 or self.context[i] != self.context[i - 1] for i in range(n)], bool)
        self.root = np.cumsum(new) - 1  # of every row
        self._build(row, label)
        self._walk(row, label, size, values)

    def _build(self, row: np.ndarray, label: np.ndarray) -> None:
        roots = total = int(self.root.max(initial=-1)) + 1
        node, parent, labels = self.root.copy(), [], []
        for lo, hi in zip(self.levels, self.levels[1:]):
            r, a = row[lo:hi], label[lo:hi]
            p = node[r]
            new = np.concatenate([[True], (p[1:] != p[:-1]) | (a[1:] != a[:-1])])
            node[r] = total + np.cumsum(new) - 1
            total += int(new.sum())
            parent.append(p[new])
            labels.append(a[new])
        none = np.zeros(0, np.int64)
        self.base, self.check = pack(np.concatenate([none, *parent]), np.concatenate([none, *labels]), roots)

    def _walk(self, row: np.ndarray, label: np.ndarray, size: np.ndarray, values: list[np.ndarray]) -> None:
        """Members of every node, by moving all rows through BASE and CHECK a turn at a time."""
        k, n = len(self.check), len(self.root)
        self.count, self.kids, self.leaves, self.saves, self.size, self.depth = (
            np.zeros(k, np.int64) for _ in range(6))
        self.first = np.full(k, NOBODY)
        self.end = np.full(k, -1, np.int64)  # place in ``ends``
        valid = self.ends.is_valid().to_numpy(zero_copy_only=False)
        state, offset = self.root.copy(), np.cumsum(self.m + 1) - self.m - 1
        self.at_depth, self.paths = [], {0: [], n - 1: []}

        def arrive(rows: np.ndarray, d: int) -> None:
            s, v = state[rows], offset[rows] + d
            for to, x in zip((self.count, self.kids, self.leaves, self.saves),
                             (values[0], values[2], values[3], values[4])):
                np.add.at(to, s, x[v])
            np.minimum.at(self.first, s, values[1][v])
            ended = valid[v]
            self.end[s[ended]] = v[ended]
            self.depth[s] = d
            self.at_depth.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            for r in self.paths:
                if self.m[r] >= d:
                    self.paths[r].append(int(state[r]))

        if n:
            arrive(np.arange(n), 0)
        for d, (lo, hi) in enumerate(zip(self.levels, self.levels[1:])):
            r = row[lo:hi]
            to = self.base[state[r]] + label[lo:hi]
            if (self.check[to] != state[r]).any():
                raise AssertionError("a turn leads out of the double array")
            state[r] = to
            self.size[to] = size[lo:hi]
            arrive(r, d + 1)
        self.state = state

    def keys(self, rows: list[int]) -> dict[int, bytes]:
        """Slot -> name of the node, on the paths of the given rows."""
        out = {}
        for r in rows:
            s, h, context = int(self.state[r]), hashlib.sha256(), self.context[r]
            path = [s]
            while (s := int(self.check[s])) >= 0:
                path.append(s)
            path.reverse()
            out[path[0]] = context
            for d, s in enumerate(path[1:]):
                h.update(self.codes[r][d * CODE_BYTES:(d + 1) * CODE_BYTES])
                out[s] = hashlib.sha256(context + h.digest()).digest()
        return out

    def rows(self, whole: bool, merging: bool, level: int, segment: int) -> Iterator[pa.RecordBatch]:
        """Complete nodes and roots; then, unless the shard is the ``whole`` table, its two open paths."""
        n = len(self.m)
        is_open = np.zeros(len(self.check), bool)
        if not whole:
            for path in self.paths.values():
                is_open[path] = True
        for at in reversed(self.at_depth):
            s = at[~is_open[at]]
            self.leaves[s] += self.kids[s] == 0
            self.saves[s] += (self.count[s] - 1) * self.size[s]
            s = s[self.check[s] >= 0]
            p = self.check[s]
            np.add.at(self.kids, p, 1)
            np.add.at(self.leaves, p, self.leaves[s])
            np.add.at(self.saves, p, self.saves[s])
        named = dict(zip(self.root.tolist(), self.context)) | self.keys(list(range(n)) if merging else sorted(
            {*self.paths, *np.flatnonzero(self.m == segment).tolist()}))
        for at in self.at_depth:
            s = at[~is_open[at]]
            if len(s):
                yield self._nodes(s, is_open, named, merging, level, segment)
        if not whole:
            yield self._open_paths()

    def _nodes(self, s: np.ndarray, is_open: np.ndarray, named: dict[int, bytes], merging: bool,
               level: int, segment: int) -> pa.RecordBatch:
        up, top = self.check[s], self.depth[s[0]] == 0
        is_root = top and level > 0
        # A parent that other shards or the segment above share is filled in later, by name.
        later = np.zeros(len(s), bool) if top else is_open[up] | (level > 0 and self.depth[s[0]] == 1)
        to_name = top or merging or self.depth[s[0]] == segment
        key = [named[x] if to_name else None for x in s.tolist()]
        columns = [
            pa.array(np.full(len(s), ROOT_ROW if is_root else NODE_ROW, np.int32)),
            pa.array(key, pa.binary()),
            pa.array([named[x] if y else None for x, y in zip(up.tolist(), later)], pa.binary()),
            pa.array(self.depth[s] + level * segment), pa.array(self.first[s]),
            pa.array(self.first[up], mask=later | top), pa.array(self.count[s]), pa.array(self.kids[s]),
            pa.array(self.leaves[s]), pa.array(self.saves[s]),
            self.ends.take(pa.array(self.end[s], mask=self.end[s] < 0)).cast(pa.string())]
        return _whole(columns, len(s))

    def _open_paths(self) -> pa.RecordBatch:
        shared, rows = set(), sorted(self.paths)
        flat, ends, lengths = [[] for _ in range(6)], [], []
        for r in rows:
            path = np.array(self.paths[r])
            # A node on both paths hands on what it has gathered once.
            fresh = np.array([s not in shared for s in path.tolist()])
            shared.update(path.tolist())
            flat[0].append(self.size[path[1:]])
            for f, x in zip(flat[1:], (self.count, self.first, self.kids, self.leaves, self.saves)):
                f.append(np.where(fresh, x[path], NOBODY if x is self.first else 0))
            ends.append(np.where(fresh, self.end[path], -1))
            lengths.append(len(path))
        place = np.concatenate(ends)
        columns = [pa.array([self.context[r] for r in rows], pa.binary()),
                   pa.array([self.codes[r] for r in rows], pa.binary()),
                   _lists(np.concatenate(flat[0]), [x - 1 for x in lengths]),
                   *(_lists(np.concatenate(f), lengths) for f in flat[1:]),
                   _lists(self.ends.take(pa.array(place, mask=place < 0)).cast(pa.string()), lengths)]
        kind = [pa.array(np.full(len(rows), PATH_ROW, np.int32))]
        return _whole(kind, len(rows), columns)


def _fields(ddl: str) -> list[tuple[str, pa.DataType]]:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(),
             "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return [(name, types[kind]) for name, kind in (f.split() for f in ddl.split(", "))]


def _whole(node: list[pa.Array], n: int, path: list[pa.Array] = ()) -> pa.RecordBatch:
    fields = _fields(NODE) + _fields(PATH)
    node = [*node, *(pa.nulls(n, t) for _, t in _fields(NODE)[len(node):])]
    path = path or [pa.nulls(n, t) for _, t in _fields(PATH)]
    return pa.record_batch([*node, *path], names=[name for name, _ in fields])


def _shards(batches: Iterator[pa.RecordBatch], shard_turns: float) -> Iterator[pa.RecordBatch]:
    """Sorted rows, cut after about ``shard_turns`` turns and rows, SHARD_ROWS rows at least."""
    held, turns, n = [], 0, 0
    for b in batches:
        lo = 0
        for i, codes in enumerate(b.column(1).to_pylist()):
            turns, n = turns + 1 + len(codes) // CODE_BYTES, n + 1
            if turns >= shard_turns and n >= SHARD_ROWS:
                yield pa.concat_batches([*held, b.slice(lo, i + 1 - lo)])
                held, lo, turns, n = [], i + 1, 0, 0
        if lo < len(b):
            held.append(b.slice(lo))
    if held:
        yield pa.concat_batches(held)


def _walk_level(paths: DataFrame, level: int, shard_turns: int, segment: int) -> list[DataFrame]:
    """Tables of complete nodes and roots of one level of segments, a round each."""
    out, merging, before, parts = [], False, 0, shuffle_partitions(paths.sparkSession)
    while True:
        n, turns = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0))).first()
        if merging and n > before / 2:  # few rows a partition: let fewer shards hold more
            shard_turns, parts = 4 * shard_turns, -(-parts // 4)
        before = n
        whole = n <= SHARD_ROWS or turns < shard_turns
        if whole:
            rows = paths.coalesce(1)
        else:
            rows = paths.repartitionByRange(max(1, min(parts, turns // shard_turns, n // SHARD_ROWS)), "context", "codes")

        def walk(batches: Iterator[pa.RecordBatch], whole: bool = whole, merging: bool = merging,
                 most: float = float("inf") if whole else shard_turns) -> Iterator[pa.RecordBatch]:
            for rows in _shards(batches, most):
                yield from Shard(rows).rows(whole, merging, level, segment)

        names = [f.split()[0] for f in PATH.split(", ")]
        found = stored(rows.sortWithinPartitions("context", "codes").select(names).mapInArrow(
            walk, f"{NODE}, {PATH}"), "trie-nodes")
        out.append(found.where(F.col("kind") != PATH_ROW).select([f.split()[0] for f in NODE.split(", ")]))
        if whole:
            return out
        paths, merging = found.where(F.col("kind") == PATH_ROW).select(names), True


def prefix_nodes(turns: DataFrame, shard_turns: int = SHARD_TURNS, segment: int = SEGMENT) -> DataFrame:
    """One row per node of the trie of conversations given as (conv_id, pos, code, size).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    rows = sequences(turns, segment)
    ends = end_hashes(rows.where("last").select("key", "conv_id"))
    paths = rows.groupBy("key").agg(
        F.first("segment").alias("segment"), F.first("context").alias("context"), F.first("codes").alias("codes"),
        F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
    paths = stored(paths.join(ends, "key", "left"), "trie-paths")
    m, nodes, below = F.size("sizes"), [], None
    zero = F.lit(0).cast("long")

    def only_last(last: Column, other: Column) -> Column:
        return F.concat(F.array_repeat(other, m), F.array(last))

    for level in range(paths.agg(F.max("segment")).first()[0] or 0, -1, -1):
        here = paths.where(F.col("segment") == level)
        if below is None:
            here = here.withColumns({"k": zero, "l": zero, "s": zero})
        else:
            here = here.join(below, "key", "left").na.fill(0, ["k", "l", "s"])
        here = here.select("context", "codes", "sizes", F.array_repeat("n", m + 1).alias("counts"),
                           F.array_repeat("first", m + 1).alias("firsts"), only_last(F.col("k"), zero).alias("kids"),
                           only_last(F.col("l"), zero).alias("leaves"), only_last(F.col("s"), zero).alias("saves"),
                           only_last(F.col("end"), F.lit(None).cast("string")).alias("ends"))
        found = _walk_level(here, level, shard_turns, segment)
        nodes += [f.where(F.col("kind") == NODE_ROW) for f in found]
        if level:
            tops = [f.where(F.col("kind") == ROOT_ROW).select(
                "key", F.col("n_children").alias("k"), F.col("n_leaves").alias("l"),
                F.col("saved_tokens").alias("s")) for f in found]
            below = tops[0]
            for t in tops[1:]:
                below = below.unionByName(t)
    out = nodes[0]
    for t in nodes[1:]:
        out = out.unionByName(t)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end"]
    open_ = out.where(F.col("parent_key").isNotNull())
    names = out.where(F.col("key").isNotNull()).select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    salt = F.pmod(F.col("conv_id"), F.lit(SALT))
    if names.count() <= BROADCAST_NODES:
        filled = open_.join(F.broadcast(names), "parent_key")
    else:
        spread = names.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        filled = open_.withColumn("salt", salt).join(spread, ["parent_key", "salt"])
    filled = filled.withColumn("parent_conv_id", F.col("parent")).select(columns)
    return out.where(F.col("parent_key").isNull()).select(columns).unionByName(filled).select(
        *columns[:-1], F.coalesce("end", F.lit(NO_ENDS)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = in_order(turn_digests(table(spark, sf_dir, "conversations")))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return prefix_nodes(grafted(rows, spans, F.col("conv_id") - F.col("conv_id") % 100, taken, 5))


def oracle() -> str:
    """DuckDB: lists of rebuilt turns; a node is a list of (role, text), its subtree the nodes it begins."""
    crc = ("list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), "
           "lambda x: ascii(x)::bigint)), lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: "
           "xor(v >> 1, 3988292384 * (v & 1))))")
    return f"""
with t as (
  select conv_id as c, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) as turn,
         row_number() over (partition by conv_id order by turn nulls first) - 1 as pos
  from conversations where conv_id is not null),
own as (select c, list(turn order by pos) as turns from t group by c),
h as (select *, xor({crc}, 4294967295) % 6 as h from own),
b as (
  select h.c, list_concat(coalesce(list_slice(o.turns, 1, h.h), []), list_slice(h.turns, h.h + 1, len(h.turns))) as p
  from h left join own o on o.c = h.c - h.c % 100),
m as (select c, p, unnest(range(0, len(p) + 1)) as depth from b),
n as (
  select p[1:depth] as p, depth, min(c) as conv_id, count(*) as n_convs,
         string_agg(case when len(p) = depth then c::varchar end, ',' order by c) as ends
  from m group by p[1:depth], depth),
k as (select p[1:depth - 1] as p, count(*) as n_children from n where depth > 0 group by 1),
v as (
  select n.*, coalesce(n_children, 0) as n_children,
         case when depth > 0 then (n_convs - 1) * length(n.p[depth].t) else 0 end as own
  from n left join k on k.p = n.p),
up as (select p, own, n_children = 0 as leaf, unnest(range(0, depth + 1)) as d from v),
s as (select p[1:d] as p, sum(own)::bigint as saved_tokens, count_if(leaf) as n_leaves from up group by p[1:d])
select v.conv_id, v.depth, q.conv_id as parent_conv_id, v.n_convs, v.n_children, s.n_leaves::bigint as n_leaves,
       s.saved_tokens, sha256(coalesce(v.ends, '')) as ends_sha256
from v join s on s.p = v.p left join n q on v.depth > 0 and q.p = v.p[1:v.depth - 1]"""
