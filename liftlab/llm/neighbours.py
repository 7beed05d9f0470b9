"""Nearest neighbours by largest inner product with randomly rotated one-bit codes.

Every vector v is scaled to length 1, rotated by a random orthogonal matrix into
D = CODE_FACTOR times its dimension (a multiple of 64), and kept as the D signs
of the result, its length |v|, and the correction a = <signs / sqrt(D), rotated v / |v|>.
For a query q, <signs / sqrt(D), rotated q> / a estimates <v / |v|, q> without
bias, and the error is at most |q| * sqrt((1 - a^2) / a^2) * epsilon / sqrt(D - 1) but
with a probability that vanishes with ``epsilon`` (EPSILON unless given; None compares every vector, so
nothing can be missed). A task walks over its part of the index and
keeps each query's best exact products so far; only vectors whose upper bound
reaches the query's k-th best are reranked with their original components, in double
precision. In the first rows, the k-th largest lower bound stands in for that.

Queries go out in blocks of QUERY_BLOCK (a broadcast of QUERY_BLOCK * dimension
* 8 bytes, whatever the number of queries); each block is one scan of the index, which is
never shuffled. The best k of every task are merged in steps of 32 tasks.

Defined cases. Vectors that are null, empty or zero, or hold null or non-finite
components, take no part, neither as query nor as candidate; nor do rows with
a null id. A vector is compared with vectors of its own dimension only. Repeated
ids: every query row gets its own list, every candidate row its own place, and rows
with the query's id are never candidates. Ties go to the smaller id. With fewer
than k candidates all are returned; an empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftlab.llm.common import ranked, stored, table

K = 20
CODE_FACTOR = 4
EPSILON = 3.0
SEED = 7
QUERY_BLOCK = 8192
CHUNK_ROWS = 1024
MERGED_AT_ONCE = 32
#: Room for rounding in single-precision estimates.
SLACK = 1e-5


@functools.lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """D x dim matrix with orthonormal columns."""
    d = -(-CODE_FACTOR * dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng((SEED, dim)).standard_normal((d, d)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def rows_of(vectors: pa.ListArray, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, length and correction of every row."""
    scale = np.abs(v).max(axis=1)  # squares of very large or small components would not fit
    length = scale * np.linalg.norm(v / scale[:, None], axis=1)
    r = (v / scale[:, None]) @ rotation(v.shape[1]).T
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    return (np.packbits(r > 0, axis=1), length, np.abs(r).sum(axis=1) / np.sqrt(r.shape[1]))


def build_index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Stored (vec_id, dim, code, length, correction, vector) of every usable row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                code, length, correction = encode(rows_of(part.column(1), int(dim)))
                codes = pa.Array.from_buffers(
                    pa.binary(), len(code), [None, pa.py_buffer(np.arange(
                        0, code.size + 1, code.shape[1], dtype=np.int32)), pa.py_buffer(code.tobytes())])
                yield pa.record_batch([part.column(0), pa.array(np.full(len(code), dim, np.int32)), codes,
                                       pa.array(length), pa.array(correction), part.column(1)],
                                      names=["vec_id", "dim", "code", "length", "correction", "vector"])

    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"),
                          F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    return stored(rows.mapInArrow(run, "vec_id long, dim int, code binary, length double, "
                                       "correction double, vector array<double>"), "ann-index")


class Search:
    """The best products of a block of queries (of one dimension) over the rows seen so far."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int,
                 epsilon: float | None = EPSILON) -> None:
        self.epsilon = np.inf if epsilon is None else epsilon
        order = np.argsort(ids, kind="stable")
        self.number, self.ids, self.q, self.k = number[order], ids[order], q[order], k
        self.norm = np.linalg.norm(self.q, axis=1)
        self.rotated = (self.q @ rotation(q.shape[1]).T).astype(np.float32)
        self.score = np.full((len(q), k), -np.inf)
        self.best = np.full((len(q), k), np.iinfo(np.int64).max)
        self.compared = 0

    def add(self, ids: np.ndarray, code: np.ndarray, length: np.ndarray, correction: np.ndarray,
            v: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            self._add(ids, code, length, correction, v)

    def _add(self, ids: np.ndarray, code: np.ndarray, length: np.ndarray, correction: np.ndarray,
             v: np.ndarray) -> None:
        d = self.rotated.shape[1]
        signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
        factor = (length / (np.sqrt(d) * correction)).astype(np.float32)
        wide = np.sqrt(np.maximum(1 - correction ** 2, 0)) / correction * self.epsilon / np.sqrt(d - 1) + SLACK
        room = np.outer(self.norm, length * wide).astype(np.float32)
        estimate = self.rotated @ (signs * factor[:, None]).T
        # A query's own rows are no candidates.
        lo, hi = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        own = np.repeat(np.arange(len(ids)), hi - lo)
        skip = np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange(len(own)), own
        estimate[skip] = -np.inf
        least = self.score[:, -1].astype(np.float32)
        if np.isneginf(least).any() and len(ids) >= self.k:
            low = np.partition(estimate - room, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            least = np.maximum(least, low)
        least -= np.abs(least) * SLACK
        # Values beyond single precision compare as unknown and are reranked.
        near = ~(estimate + room < least[:, None])
        near[skip] = False
        qi, di = np.nonzero(near)
        self.compared += len(qi)
        for a in range(0, len(qi), 1 << 18):
            self._rerank(qi[a:a + (1 << 18)], di[a:a + (1 << 18)], ids, v)

    def _rerank(self, qi: np.ndarray, di: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        s = np.einsum("ij,ij->i", self.q[qi], v[di])
        keep = s >= self.score[qi, -1]
        qi, s, i = qi[keep], s[keep], ids[di[keep]]
        used = np.unique(qi)
        qi = np.concatenate([np.repeat(used, self.k), qi])
        s = np.concatenate([self.score[used].reshape(-1), s])
        i = np.concatenate([self.best[used].reshape(-1), i])
        order = np.lexsort((i, -s, qi))
        qi, s, i = qi[order], s[order], i[order]
        first = np.flatnonzero(np.concatenate([[True], qi[1:] != qi[:-1]])) if len(qi) else qi
        place = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi))))
        top = place < self.k
        self.score[used] = s[top].reshape(-1, self.k)
        self.best[used] = i[top].reshape(-1, self.k)


def _merged(found: DataFrame, k: int, parts: int) -> DataFrame:
    """Best k per query number of the tasks' lists, MERGED_AT_ONCE tasks at a time."""
    while True:
        parts = -(-parts // MERGED_AT_ONCE)
        found = found.withColumn("part", F.floor(F.col("part") / MERGED_AT_ONCE).cast("int"))
        order = Window.partitionBy("number", "part").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if parts <= 1:
            return found.drop("part")


def search(index: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK,
           epsilon: float | None = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of the index for every query.

    ``queries``: rows (vec_id, vector) of an index. ``epsilon=None`` is the exact search. One block's
    queries are broadcast at a time: each block's result is stored and its broadcast given back.
    """
    spark = index.sparkSession
    sizes = queries.select("vec_id", "vector", F.hash("vector").alias("_h"))
    numbered = stored(ranked(sizes, ["vec_id", "_h"], "ann-order", "number").select(
        "number", "vec_id", "vector"), "ann-queries")
    total, out = numbered.count(), None
    scan = index.select("vec_id", "code", "length", "correction", "vector")
    parts = scan.rdd.getNumPartitions()
    for a in range(0, max(total, 1), query_block):
        block = numbered.where((F.col("number") >= a) & (F.col("number") < a + query_block)).toArrow()
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = sent.value.combine_chunks()
            number, ids = q.column("number").to_numpy(), q.column("vec_id").to_numpy()
            lists = q.column("vector").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            by_dim = {int(d): Search(number[dims == d], ids[dims == d],
                                     rows_of(lists.filter(pa.array(dims == d)), int(d)), k, epsilon)
                      for d in np.unique(dims)}
            for b in batches:
                dims = b.column(4).value_lengths().to_numpy(zero_copy_only=False)
                for d in np.unique(dims):
                    if int(d) not in by_dim:
                        continue
                    rows = b.filter(pa.array(dims == d))
                    for c in range(0, len(rows), CHUNK_ROWS):
                        r = rows.slice(c, CHUNK_ROWS)
                        code = np.frombuffer(b"".join(r.column(1).to_pylist()), np.uint8).reshape(len(r), -1)
                        by_dim[int(d)].add(r.column(0).to_numpy(), code, r.column(2).to_numpy(),
                                           r.column(3).to_numpy(), rows_of(r.column(4), int(d)))
            part = TaskContext.get().partitionId()
            for s in by_dim.values():
                qi, place = np.nonzero(~np.isneginf(s.score))
                yield pa.record_batch([pa.array(s.number[qi]), pa.array(s.ids[qi]),
                                       pa.array(s.best[qi, place]), pa.array(s.score[qi, place]),
                                       pa.array(np.full(len(qi), part, np.int32))],
                                      names=["number", "query_id", "vec_id", "score", "part"])

        found = scan.mapInArrow(run, "number long, query_id long, vec_id long, score double, part int")
        best = _merged(found, k, parts).select("query_id", "rank", "vec_id", "score")
        best = stored(best, "ann-found")
        sent.destroy()
        out = best if out is None else out.unionByName(best)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "embeddings"))
    return search(index, index.where(F.col("vec_id") % 20 == 0))
