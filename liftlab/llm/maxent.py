"""Language-model scoring with a hashed maximum-entropy model.

A text is scored as log10 P(text) = sum over its tokens (words, then one end)
of log10 P(class | context) + log10 P(token | class, context).

* P(class | context) is a maximum-entropy model, a softmax over CLASSES classes
  whose logits sum the weights of hashed context features: the previous word,
  the previous two words (n-grams), and the words two and three places back
  (skips). The most frequent words are classes of their own; the others are
  classed by their last bytes; the end is a class.
* P(token | class, context) is a product of binary decisions down the class's
  tree, whose leaves are its words with at least LEARNT_FROM occurrences (of at most FREQUENT_WORDS in all)
  and one for its other words, split where the halves weigh alike. Each decision is a
  maximum-entropy model of its own over the same context features; its weights are hashed by
  (feature, node). Without weights a path's probability is the leaf's share of add-one
  counts, (c + 1) / (sum of c + 1 over the class, plus 1). The other words divide their
  leaf by add-one counts, with one share for all words not seen in training. So do words that are
  a class of their own and the end.

Training: token counts and class totals are aggregated over all training texts.
The softmax weights are then trained by distributed gradient updates: every
task reads its training texts in batches and takes AdaGrad steps on its own
copy of the weights, where a batch's expected feature counts are estimated by
one class drawn from the model per token; the tasks' changes are merged row by
row (mean over the tasks that touched the row), 16 tasks at a time. The decisions'
weights are trained and merged in the same pass, with exact gradients and
cell by cell. The model has a fixed size of (4 * BUCKETS + 1) * CLASSES + CELLS floats.

Scoring: sparse numpy batches. The counts of at most FREQUENT_WORDS words, the
most frequent ones, are broadcast; the remaining distinct words of a text are
joined with the stored counts. Words are identified by 64-bit hashes.

Defined cases. Null, empty and blank texts are the end alone. Rows without an
id are trained on. Repeated rows are counted and scored one by one. Without any
training text, N = V = 0 and every token is unknown. An empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlab.llm.common import chunks, coded_words, stored, table

CLASSES = 64
#: Classes that hold one frequent word each.
OWN_CLASSES = 16
#: Hashed rows of weights per feature kind.
BUCKETS = 1 << 14
FREQUENT_WORDS = 1 << 20
#: Occurrences from which a word has decisions of its own; fewer are too little to learn their weights from.
LEARNT_FROM = 64
#: Hashed weights of the decisions within classes, and the evidence that speaks for a weight of 0.
CELLS = 1 << 20
CELL_PRIOR = 8.0
BLOCK_CELLS = 1 << 17
STEP_TOKENS = 1 << 16
RATE = 1.0
#: Copies of the weights merged in one group, and rows of a copy per record.
MERGED_AT_ONCE = 16
BLOCK_ROWS = 1 << 12
#: Weights that a step updates at a time.
SWEPT_ROWS = 1 << 10
SWEPT_CELLS = 1 << 14
KINDS = 4
_ROWS = KINDS * BUCKETS + 1  # the last row is the bias
_CELL_BLOCK = -(-_ROWS // BLOCK_ROWS)  # the first block of cells
_SLICE = 1 << 13
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                    0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Stands for the end; no word can contain a line feed.
END = np.int64(np.uint64(xxhash.xxh3_64_intdigest(b"\n")).astype(np.int64))


def word_hashes(names: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)).view(np.int64)


def word_classes(names: list[bytes]) -> np.ndarray:
    """Class of each word by its last two bytes (before frequent words get their own)."""
    size = np.fromiter(map(len, names), np.int64, len(names))
    ends = np.cumsum(size) + 1
    data = np.frombuffer(b"\0\0" + b"".join(names), dtype=np.uint8)
    last = np.where(size > 0, data[ends], 0) + np.where(size > 1, data[ends - 1], 0).astype(np.uint64) * np.uint64(256)
    mixed = (last * _MIX[0]) >> np.uint64(40)
    return (mixed % np.uint64(CLASSES - 1 - OWN_CLASSES)).astype(np.int32) + 1 + OWN_CLASSES


def places(of: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """np.searchsorted(of, keys), asked in order of the keys: neighbours lie together in memory."""
    order, out = np.argsort(keys), np.empty(len(keys), dtype=np.int64)
    out[order] = np.searchsorted(of, keys[order])
    return out


@dataclass
class Tokens:
    """Tokens of several texts in order, each text closed by the end."""

    hash: np.ndarray
    cls: np.ndarray
    place: np.ndarray  # within the text
    text: np.ndarray  # number of the text
    code: np.ndarray  # of the distinct word; the end comes last
    distinct: np.ndarray  # hashes of the distinct words

    @classmethod
    def of(cls, texts: pa.Array, own: dict[int, int]) -> Tokens:
        code, bounds, names = coded_words(texts)
        size = np.diff(bounds) + 1
        ends = np.cumsum(size) - 1
        full = np.full(len(code) + len(size), len(names), dtype=np.int64)
        words = np.ones(len(full), bool)
        words[ends] = False
        full[words] = code
        distinct = np.append(word_hashes(names), END)
        kind = np.append(word_classes(names), 0).astype(np.int32)
        for h, k in own.items():
            kind[distinct == h] = k
        return cls(distinct[full], kind[full], np.arange(len(full)) - np.repeat(ends - size + 1, size),
                   np.repeat(np.arange(len(size)), size), full, distinct)

    @functools.cached_property
    def features(self) -> np.ndarray:
        """Hash of each kind's context feature, per token."""
        h = self.hash.view(np.uint64)
        out = np.empty((KINDS, len(h)), dtype=np.uint64)
        for k, b in ((1, out[0]), (2, out[2]), (3, out[3])):
            b.fill(END.astype(np.uint64) if k == 1 else k)
            np.copyto(b[k:], h[:-k], where=self.place[k:] >= k)
        np.multiply(out[0], _MIX[1], out=out[1])
        out[1] ^= out[2]
        out *= np.array(_MIX)[[0, 2, 3, 4], None]
        return out

    def feature_rows(self) -> np.ndarray:
        """Row of the weights of each feature kind, per token."""
        shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
        return np.stack([(m >> shift).astype(np.int32) + k * BUCKETS
                         for k, m in enumerate(self.features)])


@dataclass
class Tree:
    """A binary tree over the leaves of each class; a class of one leaf has none.

    Leaves are in order of class; a node's number is the first leaf of its right side.
    """

    words: np.ndarray  # sorted hashes
    leaf: np.ndarray  # of each word
    rest: np.ndarray  # leaf of each class's other words
    weight: np.ndarray  # of each leaf
    root: np.ndarray  # of each class; 0 is no node
    child: np.ndarray  # nodes on the left and the right; 0 is a leaf
    logit: np.ndarray  # of each node without weights

    @classmethod
    def of(cls, h: np.ndarray, kind: np.ndarray, c: np.ndarray, class_total: np.ndarray) -> Tree:
        keep = kind > OWN_CLASSES
        h, kind, c = h[keep], kind[keep], c[keep].astype(np.float64) + 1
        other = class_total - np.bincount(kind, c, minlength=CLASSES)
        h = np.append(h, np.zeros(CLASSES, dtype=np.int64))
        is_rest = np.arange(len(h)) >= len(kind)
        kind, weight = np.append(kind, np.arange(CLASSES)), np.append(c, other)
        order = np.lexsort((h, -weight, kind))
        place = np.empty(len(h), dtype=np.int32)
        place[order] = np.arange(len(h))
        weight, is_word = weight[order], ~is_rest
        upto = np.append(0, np.cumsum(weight))
        root, child = np.zeros(CLASSES, np.int32), np.zeros((2, len(h)), np.int32)
        logit = np.zeros(len(h), np.float32)

        def cut(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            return np.clip(np.searchsorted(upto, (upto[lo] + upto[hi]) / 2), lo + 1, hi - 1)

        ends = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        split = np.flatnonzero(np.diff(ends) > 1)
        lo, hi = ends[split], ends[split + 1]
        mid = root[split] = cut(lo, hi)
        while len(mid):
            logit[mid] = np.log((upto[hi] - upto[mid]) / (upto[mid] - upto[lo]))
            below = []
            for side, (a, b) in enumerate(((lo, mid), (mid, hi))):
                on = b - a > 1
                m = child[side, mid[on]] = cut(a[on], b[on])
                below.append((a[on], b[on], m))
            lo, hi, mid = (np.concatenate(x) for x in zip(*below))
        by_hash = np.argsort(h[is_word])
        return cls(h[is_word][by_hash], place[is_word][by_hash], place[is_rest], weight, root, child, logit)

    def leaves(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Leaf of each word."""
        if not len(self.words):
            return self.rest[kind]
        at = np.minimum(places(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.leaf[at], self.rest[kind])

    def paths(self, leaf: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of each word's decisions, their nodes, and whether they go right."""
        word, node, found = np.arange(len(leaf)), self.root[kind], []
        while len(word):
            on = node > 0
            word, node = word[on], node[on]
            right = leaf[word] >= node
            found.append((word, node, right))
            node = self.child[right.astype(np.int8), node]
        word, node, right = (np.concatenate(x) for x in zip(*found)) if found else (
            np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool))
        order = np.argsort(word, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(word, minlength=len(leaf))))
        return ends, node[order], right[order]


class Decisions:
    """The decisions within classes of all tokens of several texts."""

    def __init__(self, tree: Tree, t: Tokens) -> None:
        self.tree, self.code, self.features = tree, t.code, t.features
        kind = np.zeros(len(t.distinct), dtype=np.int32)
        kind[t.code] = t.cls
        leaf = tree.leaves(t.distinct, kind)
        # What the words below a leaf share; a word that is a leaf has all of it.
        self.log_weight = np.log10(tree.weight)[leaf][t.code]
        self.ends, self.node, self.right = tree.paths(leaf, kind)

    def of(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens a to b: token, cells by kind, logit without weights, and side of each decision."""
        code = self.code[a:b]
        sizes = self.ends[code + 1] - self.ends[code]
        total = np.cumsum(sizes)
        n = total[-1] if len(total) else 0
        # A decision's token: how many tokens end before it or where it is.
        token = np.cumsum(np.bincount(total, minlength=n)[:n])
        pick = np.take(self.ends[code] - (total - sizes), token, mode="clip")
        pick += np.arange(n)
        node = self.node[pick]
        own = node.astype(np.uint64) * _MIX[1]
        shift = np.uint64(64 - (CELLS.bit_length() - 1))
        cells = np.empty((KINDS, len(token)), dtype=np.int64)
        for k in range(KINDS):
            x = np.take(self.features[k, a:b], token, mode="clip")
            x ^= own
            x *= _MIX[(k + 2) % 5]
            np.right_shift(x, shift, out=cells[k].view(np.uint64))
        return token, cells, self.tree.logit[node], self.right[pick]

    def log10(self, weights: np.ndarray) -> np.ndarray:
        """log10 P(leaf | class, context) of each token."""
        out = np.empty(len(self.code))
        for a in range(0, len(self.code), STEP_TOKENS):
            token, cells, x, right = self.of(a, a + STEP_TOKENS)
            x = decision_logits(weights, cells, x)
            n = len(self.code[a:a + STEP_TOKENS])
            x.view(np.uint32)[:] ^= right.astype(np.uint32) << np.uint32(31)  # -x where the right side is taken
            np.exp(x, out=x)
            x += 1
            out[a:a + n] = np.bincount(token, np.log(x, out=x), minlength=n)
        return out / -np.log(10)


def decision_logits(weights: np.ndarray, cells: np.ndarray, logit: np.ndarray) -> np.ndarray:
    x = logit.copy()
    for c in cells:
        x += np.take(weights, c, mode="clip")
    return np.clip(x, -40, 40, out=x)


def class_exponentials(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """exp(logit) of every class, per token; logits are kept in a safe range."""
    x = np.take(weights, rows[0], axis=0, mode="clip")
    more = np.empty_like(x)
    for r in rows[1:]:
        x += np.take(weights, r, axis=0, out=more, mode="clip")
    x += weights[-1]
    np.clip(x, -40, 40, out=x)
    return np.exp(x, out=x)


def class_factors(weights: np.ndarray) -> np.ndarray | None:
    """exp(weight) of weights that stay as they are, the bias in those of the first kind.

    None if products of them could leave the range of floats.
    """
    most = np.abs(weights[:-1]).reshape(KINDS, -1).max(axis=1).sum() + np.abs(weights[-1]).max()
    if not most <= 80:
        return None
    factors = weights[:-1].copy()
    factors[:BUCKETS] += weights[-1]
    return np.exp(factors, out=factors)


def class_products(factors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """class_exponentials, up to rounding, from exp(weight): an exponential less per class and token."""
    x = np.take(factors, rows[0], axis=0, mode="clip")
    more = np.empty_like(x)
    for r in rows[1:]:
        x *= np.take(factors, r, axis=0, out=more, mode="clip")
    return np.clip(x, np.exp(np.float32(-40)), np.exp(np.float32(40)), out=x)


def class_log10(exponentials: Callable[[np.ndarray], np.ndarray], rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log10 P(class | context) of each token's class."""
    out = np.empty(len(cls))
    for a in range(0, len(cls), _SLICE):
        e = exponentials(rows[:, a:a + _SLICE])
        k = cls[a:a + _SLICE]
        chosen = e[np.arange(len(k)), k]
        out[a:a + _SLICE] = np.log(chosen.astype(np.float64) / e.sum(axis=1))
    return out / np.log(10)


def draw(e: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """One class per row, with probability in proportion to the row's values."""
    side, row = 8, np.arange(len(e))
    halved = e
    for _ in range(3):  # sums of pairs, fours and eights
        halved = halved[:, 0::2] + halved[:, 1::2]
    upto = _sums(halved)
    at = random.random(len(e), dtype=np.float32) * upto[-1]
    group = np.minimum(_passed(upto, at), len(upto) - 1)
    inner = _sums(np.take(e.reshape(-1, side), row * (e.shape[1] // side) + group, axis=0))
    rest = at - (upto[group, row] - inner[-1])
    return group * side + np.minimum(_passed(inner, rest), side - 1)


def _sums(x: np.ndarray) -> np.ndarray:
    """Running sums of each row's values, a column per row of x."""
    out = np.ascontiguousarray(x.T)
    for a, b in zip(out, out[1:]):
        b += a
    return out


def _passed(upto: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of a column's sums are at its value or below."""
    return np.add.reduce((upto <= at).view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)


class Trainer:
    """A task's own copy of the weights and its AdaGrad state."""

    def __init__(self, weights: np.ndarray, seed: int) -> None:
        self.start, self.weights = weights, weights.copy()
        self.cells = np.zeros(CELLS, dtype=np.float32)
        self.cell_power = np.full(CELLS, CELL_PRIOR, dtype=np.float32)
        self.power = np.full((_ROWS, 1), 1e-6, dtype=np.float32)
        self.gap = np.zeros_like(weights)  # of a step; zero between steps
        self.random = np.random.default_rng(seed)

    def step(self, rows: np.ndarray, cls: np.ndarray) -> None:
        drawn = np.empty(len(cls), dtype=np.int64)
        for a in range(0, len(cls), _SLICE):
            drawn[a:a + _SLICE] = draw(class_exponentials(self.weights, rows[:, a:a + _SLICE]), self.random)
        seen = np.bincount(rows.reshape(-1), minlength=_ROWS)
        seen[-1] = len(cls)
        gap = self.gap.reshape(-1)
        other = np.flatnonzero(drawn != cls)  # where they agree, no gap is left
        drawn, cls = drawn[other], cls[other]
        for r in rows:
            c = r[other] * np.int64(CLASSES)
            np.add.at(gap, c + drawn, np.float32(1))
            np.subtract.at(gap, c + cls, np.float32(1))
        self.gap[-1] = np.bincount(drawn, minlength=CLASSES) - np.bincount(cls, minlength=CLASSES)
        # The noise of a row's gap grows with the root of its tokens.
        root = np.sqrt(np.maximum(seen, 1))[:, None].astype(np.float32)
        for a in range(0, _ROWS, SWEPT_ROWS):  # rows that stay in the processor's cache meanwhile
            part = slice(a, a + SWEPT_ROWS)
            if seen[part].any():
                g = self.gap[part]
                g /= root[part]
                power = self.power[part]
                power += np.einsum("ij,ij->i", g, g)[:, None]
                g *= RATE / np.sqrt(power)
                self.weights[part] -= g
                g.fill(0)

    def decide(self, cells: np.ndarray, logit: np.ndarray, right: np.ndarray) -> None:
        """A step on the decisions within classes."""
        gap = 1 / (1 + np.exp(-decision_logits(self.cells, cells, logit))) - right
        every = cells.reshape(-1)
        g = np.bincount(every, np.tile(gap.astype(np.float64), KINDS), minlength=CELLS)
        power = np.bincount(every, np.tile((gap * gap).astype(np.float64), KINDS), minlength=CELLS)
        # A Newton step: the kinds of feature share what a decision asks for.
        power *= KINDS
        for a in range(0, CELLS, SWEPT_CELLS):
            part = slice(a, a + SWEPT_CELLS)
            self.cell_power[part] += power[part].astype(np.float32)
            self.cells[part] -= (g[part] / self.cell_power[part]).astype(np.float32)

    def blocks(self, part: int) -> pa.RecordBatch:
        """The changes, as 16-bit floats, in blocks of rows, and which rows changed."""
        change = self.weights - self.start
        out: list[list] = [[], [], [], []]
        for b, a in enumerate(range(0, _ROWS, BLOCK_ROWS)):
            c = change[a:a + BLOCK_ROWS]
            hit = np.any(c, axis=1)
            for to, v in zip(out, (b, part, c.astype("<f2").tobytes(), hit.astype("<i4").tobytes())):
                to.append(v)
        for b, a in enumerate(range(0, CELLS, BLOCK_CELLS)):  # a cell is a row here
            c = self.cells[a:a + BLOCK_CELLS].astype("<f2")
            for to, v in zip(out, (_CELL_BLOCK + b, part, c.tobytes(), (c != 0).astype("<i4").tobytes())):
                to.append(v)
        return pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()),
                                pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
                               names=["block", "part", "change", "hits"])


_BLOCKS = "block int, part long, change binary, hits binary"


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Mean change of each weight row over the copies that touched it."""
    hits = np.stack([np.frombuffer(x, "<i4") for x in rows["hits"]])
    change = np.stack([np.frombuffer(x, "<f2").astype(np.float32) for x in rows["change"]])
    change = change.reshape(*hits.shape, -1)
    total = hits.sum(axis=0, dtype=np.int32)
    mean = (change * hits[:, :, None].astype(np.float32)).sum(axis=0) / np.maximum(total, 1)[:, None]
    return pd.DataFrame({"block": [key[0]], "part": [key[1]],
                         "change": [mean.astype("<f2").tobytes()], "hits": [total.astype("<i4").tobytes()]})


@dataclass
class Model:
    counts: DataFrame  # stored (h, c)
    n: int
    v: int
    own: dict[int, int]
    class_total: np.ndarray
    threshold: int  # words with at least this count are broadcast
    frequent: tuple[np.ndarray, np.ndarray]
    weights: np.ndarray
    tree: Tree
    cells: np.ndarray


def token_counts(texts: DataFrame) -> DataFrame:
    """(text) -> stored (h, cls, c): occurrences of every token in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, 0):
                code, _, names = coded_words(c.column(0))
                n = np.append(np.bincount(code, minlength=len(names)), len(c)).astype(np.int64)
                yield pa.record_batch([pa.array(np.append(word_hashes(names), END)),
                                       pa.array(np.append(word_classes(names), 0).astype(np.int32)),
                                       pa.array(n)], names=["h", "cls", "n"])

    rows = texts.select("text").mapInArrow(run, "h long, cls int, n long")
    return stored(rows.groupBy("h", "cls").agg(F.sum("n").alias("c")).where("c > 0"), "lm-counts")


def train_weights(texts: DataFrame, start: np.ndarray, own: dict[int, int],
                  tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """One pass of distributed gradient updates over all training texts: weights and cells."""
    first = texts.sparkSession.sparkContext.broadcast((start, own, tree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, classes, tree = first.value
        part = TaskContext.get().partitionId()
        trainer = Trainer(weights, part)
        seen = False
        for b in batches:
            for c in chunks(b, 0):
                t = Tokens.of(c.column(0), classes)
                rows, within = t.feature_rows(), Decisions(tree, t)
                for a in range(0, len(t.cls), STEP_TOKENS):
                    trainer.step(rows[:, a:a + STEP_TOKENS], t.cls[a:a + STEP_TOKENS])
                    trainer.decide(*within.of(a, a + STEP_TOKENS)[1:])
                    seen = True
        if seen:
            yield trainer.blocks(part)

    copies = stored(texts.select("text").mapInArrow(run, _BLOCKS), "lm-copies")
    first.unpersist()
    most = copies.agg(F.max("part")).first()[0]
    while most:  # part 0 is left in the end
        merged = copies.withColumn("part", F.floor(F.col("part") / MERGED_AT_ONCE))
        copies = stored(merged.groupBy("block", "part").applyInPandas(_merge, _BLOCKS), "lm-copies")
        most //= MERGED_AT_ONCE
    out, cells = start.copy(), np.zeros(CELLS, dtype=np.float32)
    for r in copies.collect():  # one model
        c = np.frombuffer(r["change"], "<f2")
        if r["block"] < _CELL_BLOCK:
            a = r["block"] * BLOCK_ROWS
            out[a:a + len(c) // CLASSES] += c.reshape(-1, CLASSES)
        else:
            a = (r["block"] - _CELL_BLOCK) * BLOCK_CELLS
            cells[a:a + len(c)] = c
    return out, cells


def train(texts: DataFrame, frequent_words: int = FREQUENT_WORDS) -> Model:
    """Counts and weights from the column ``text``."""
    counts = token_counts(texts)
    sizes = counts.groupBy(F.length(F.bin("c")).alias("bits")).agg(
        F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()
    n, v = sum(r["n"] for r in sizes), sum(r["v"] for r in sizes)
    at_least, bits = 0, 64
    for r in sorted(sizes, key=lambda r: -r["bits"]):
        at_least += r["v"]
        if at_least > frequent_words:
            break
        bits = r["bits"]
    threshold = 1 << (bits - 1) if bits < 64 else (1 << 62)
    top = counts.where(F.col("h") != int(END)).orderBy(F.desc("c"), "h").limit(OWN_CLASSES).collect()
    own = {r["h"]: i + 1 for i, r in enumerate(top)}
    class_total = np.ones(CLASSES)
    for r in counts.groupBy("cls").agg(F.sum(F.col("c") + 1).alias("t")).collect():
        class_total[r["cls"]] += r["t"]
    for r in top:
        class_total[own[r["h"]]] += r["c"] + 1
        class_total[r["cls"]] -= r["c"] + 1
    often = counts.where(F.col("c") >= threshold).select("h", "cls", "c").toArrow()  # <= frequent_words rows
    h, kind, c = (often.column(k).to_numpy() for k in ("h", "cls", "c"))
    kind = kind.copy()
    for w, k in own.items():
        kind[h == w] = k
    learnt = c >= LEARNT_FROM
    tree = Tree.of(h[learnt], kind[learnt], c[learnt], class_total)
    order = np.argsort(h)
    start = np.zeros((_ROWS, CLASSES), dtype=np.float32)
    start[-1] = np.log(class_total / class_total.sum())
    weights, cells = train_weights(texts, start, own, tree) if n else (start, np.zeros(CELLS, np.float32))
    return Model(counts.select("h", "c"), n, v, own, class_total, threshold,
                 (h[order], c[order].astype(np.int64)), weights, tree, cells)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, n_known, base_score, score)."""
    spark = docs.sparkSession
    factors = class_factors(model.weights)
    classes = (class_exponentials, model.weights) if factors is None else (class_products, factors)
    sent = spark.sparkContext.broadcast((classes, model.own, model.frequent, model.tree, model.cells))
    base_log = float(np.log10(model.n + model.v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (form, weights), own, (often, often_c), tree, cells = sent.value
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for c in chunks(b, 1):
                t, m = Tokens.of(c.column(1), own), len(c)
                at = places(often, t.distinct)
                at[at == len(often)] = 0
                known = often[at] == t.distinct if len(often) else np.zeros(len(t.distinct), bool)
                count = np.where(known, often_c[at], 0) if len(often) else np.zeros(len(at))
                log_c, is_known = np.log10(count + 1.0)[t.code], known[t.code]
                within = Decisions(tree, t)
                context = (class_log10(functools.partial(form, weights), t.feature_rows(), t.cls) + within.log10(cells)
                           - within.log_weight)
                by_text = lambda x: np.bincount(t.text, x, minlength=m)
                # The other words of each text, with their numbers.
                rare = np.flatnonzero(~is_known)
                pair, times = np.unique(t.text[rare] * np.int64(len(t.distinct)) + t.code[rare],
                                        return_counts=True)
                ends = np.searchsorted(pair, np.arange(m + 1) * np.int64(len(t.distinct)))
                offsets = pa.array(ends, pa.int32())
                yield pa.record_batch([
                    pa.array(row + np.arange(m)), c.column(0), pa.array(by_text(None)),
                    pa.array(by_text(is_known).astype(np.int64)), pa.array(by_text(log_c)),
                    pa.array(by_text(context)),
                    pa.ListArray.from_arrays(offsets, pa.array(t.distinct[pair % len(t.distinct)])),
                    pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))],
                    names=["row", "doc_id", "n_tokens", "n_often", "often_c", "context", "h", "times"])
                row += m

    parts = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "row long, doc_id long, n_tokens long, n_often long, often_c double, context double, "
             "h array<long>, times array<long>"), "lm-parts")
    words = parts.select("row", F.explode(F.arrays_zip("h", "times")).alias("w")).select(
        "row", "w.h", "w.times")
    rest = model.counts.where(F.col("c") < model.threshold)
    rare = words.join(rest, "h").groupBy("row").agg(
        F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_c"))
    full = parts.drop("h", "times").join(rare, "row", "left").na.fill(0, ["n_rare", "rare_c"])
    logs = F.col("often_c") + F.col("rare_c")
    return full.select("doc_id", "n_tokens", (F.col("n_often") + F.col("n_rare")).alias("n_known"),
                       (logs - F.col("n_tokens") * F.lit(base_log)).alias("base_score"),
                       (logs + F.col("context")).alias("score"))


def held_out(doc_id: str = "doc_id") -> Column:
    """The texts that are never learnt from: crc32 of the id's text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out()))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
