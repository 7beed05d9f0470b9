"""Embedding whitening by a weighted multiplicity covariance.

Vectors are quantised to whole numbers x (``floor(1024 c) + 100000``) and identical x vectors are grouped
(map-side first), with their multiplicities. The fit weighs each distinct vector by its count, or by one.

* Sums: every task adds weight * x per dimension, in whole numbers; exact.
* Covariance: every task centres its distinct vectors by the exact means and multiplies
  them, a block of rows at a time (a weighted GEMM of doubles); the tasks' scatter matrices are added row by row
  of the matrix, in task order.
* Components: unit eigenvectors of the covariance, by falling eigenvalue, the largest entry positive. The matrix
  has the square of the dimension as entries, whatever the number of rows, so the driver decomposes it.
* Whitening: every distinct vector is projected once; its deviation (a sum of squares of whole numbers) is exact.
  The tasks' own covariances of the result are merged pairwise for the identity error.
* The rows of ``vectors`` get the results of their x by a join. x vectors that more than a
  1024th of all rows share (so 1024 at most, or as many as shuffle partitions) are
  joined by a broadcast, so that no task reads all copies of one vector.

Defined cases. Vectors that are null or hold null or non-finite entries are left out. Vectors of
different lengths are fitted apart, each length with its own n; empty vectors give no rows. Null or repeated
ids are ordinary rows. Entries beyond 2^52 in size count as 2^52. Where a component has no variance
(its eigenvalue is 0 but for rounding) whitened is null, and the identity error is that of
the others (null if there is none); explained is null where the whole covariance is 0. A deviation that does not fit a
long is null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlab.llm.common import shuffle_partitions, stored, table

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 52)
#: Distinct vectors centred and multiplied at a time.
BLOCK_ROWS = 4096
#: An x vector with more than this share of all rows is joined by broadcast.
HOT_SHARE = 1024
#: Eigenvalues below this share of the largest are rounding.
RANK_SHARE = 1e-13


class Fit(NamedTuple):
    """Of the vectors of one length: n, sums S, and components by falling eigenvalue."""
    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def rank(self) -> int:
        return int((self.values > max(self.values.max(initial=0.0), 0.0) * RANK_SHARE * len(self.sums)).sum())


def quantised(vector: Column) -> Column:
    """x of a vector; null if the vector is null or holds null or non-finite entries."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST)) * SCALE) + SHIFT)
    return F.when(~bad, x)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Stored (x, hash, dim, count) of every different x."""
    out = rows.groupBy("x").agg(F.count(F.lit(1)).alias("count"))
    return stored(out.select("x", F.xxhash64("x").alias("hash"), F.size("x").alias("dim"), "count"), "whiten-distinct")


def _matrix(x: pa.ListArray, dim: int) -> np.ndarray:
    return x.flatten().to_numpy().reshape(-1, dim)


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Blocks (dim, x, weight, rows) of the batches (x, dim, weight, ...)."""
    for b in batches:
        dims = b.column(1).to_numpy()
        for dim in np.unique(dims).tolist():
            rows = b.filter(pa.array(dims == dim))
            for lo in range(0, len(rows), BLOCK_ROWS):
                r = rows.slice(lo, BLOCK_ROWS)
                yield dim, _matrix(r.column(0), dim), r.column(2).to_numpy(), r


def _weighted(distinct: DataFrame, weights: str) -> DataFrame:
    if weights not in ("counts", "one"):
        raise ValueError("weights must be 'counts' or 'one'")
    weight = F.col("count") if weights == "counts" else F.lit(1).cast("long")
    return distinct.where("dim > 0").select("x", "dim", weight.alias("weight"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, high, low = {}, {}, {}
    for dim, x, w, _ in _by_dim(batches):
        # Halves of x, so that sums of weight * half stay exact in 64 bits or, as Python numbers, beyond.
        n[dim] = n.get(dim, 0) + int(w.sum())
        for total, half in ((high, x >> 32), (low, x & 0xFFFFFFFF)):
            if int(w.sum()) < 1 << 30:
                part = (w @ half).tolist()
            else:
                part = [sum(a * b for a, b in zip(w.tolist(), column)) for column in half.T.tolist()]
            total[dim] = [a + b for a, b in zip(total.get(dim, [0] * dim), part)]
    for dim in n:
        whole = [(h << 32) + s for h, s in zip(high[dim], low[dim])]
        yield pa.record_batch([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()),
                               pa.array([n[dim]] * dim), pa.array([str(s) for s in whole])],
                              names=["dim", "at", "n", "sum"])


def _scatter(batches: Iterator[pa.RecordBatch], means: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    total, part = {}, TaskContext.get().partitionId()
    for dim, x, w, _ in _by_dim(batches):
        z = x - means[dim]
        total[dim] = total.get(dim, 0.0) + (z * w[:, None]).T @ z
    for dim, s in total.items():
        yield pa.record_batch(
            [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([part] * dim, pa.int32()),
             pa.ListArray.from_arrays(pa.array(np.arange(0, dim * dim + 1, dim, dtype=np.int32)), pa.array(s.reshape(-1)))],
            names=["dim", "at", "part", "row"])


def _add_rows(rows: pd.DataFrame) -> pd.DataFrame:
    row = np.sum(np.stack(rows.sort_values("part")["row"].to_list()), axis=0)
    return pd.DataFrame({"dim": rows["dim"].iloc[:1], "at": rows["at"].iloc[:1], "row": [row]})


def fit(distinct: DataFrame, weights: str = "counts") -> dict[int, Fit]:
    """Per vector length; the driver holds one matrix a length."""
    rows = _weighted(distinct, weights)
    sums = rows.mapInArrow(_sums, "dim int, at int, n long, sum string").groupBy("dim", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()
    n, total = {}, {}
    for r in sums:
        n[r["dim"]] = r["n"]
        total.setdefault(r["dim"], [0] * r["dim"])[r["at"]] = int(r["sum"])
    means = {d: np.array([s / n[d] for s in total[d]]) for d in n}

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scatter(batches, means)

    parts = rows.mapInArrow(scatter, "dim int, at int, part int, row array<double>")
    found = parts.groupBy("dim", "at").applyInPandas(_add_rows, "dim int, at int, row array<double>").collect()
    matrix = {d: np.zeros((d, d)) for d in n}
    for r in found:
        matrix[r["dim"]][r["at"]] = r["row"]
    out = {}
    for d, m in matrix.items():
        v = (m + m.T) / (2 * n[d])
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1], vectors[:, ::-1]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])
        out[d] = Fit(n[d], total[d], vectors, values, float(np.trace(v)))
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n * x - S)^2, exact; null where it does not fit a long."""
    wrapped = np.array([s & (1 << 64) - 1 for s in sums], dtype=np.uint64).view(np.int64)
    with np.errstate(over="ignore"):
        exact = ((n * x - wrapped) ** 2).sum(axis=1)  # right modulo 2^64
    about = ((x.astype(np.float64) * n - np.array([float(s) for s in sums])) ** 2).sum(axis=1)
    fits = about < 2.0 ** 63
    for i in np.flatnonzero(np.abs(about / 2.0 ** 63 - 1) < 1e-3).tolist():
        fits[i] = sum((n * a - s) ** 2 for a, s in zip(x[i].tolist(), sums)) < 1 << 63
    return pa.array(exact, mask=~fits)


def whiten(distinct: DataFrame, fits: dict[int, Fit], components: int, weights: str) -> tuple[DataFrame, dict[int, float | None]]:
    """Stored (x, hash, count, deviation, whitened array) of every distinct vector, and each length's identity error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, x, _, rows in _by_dim(batches):
            f = fits[dim]
            k, kept = min(components, dim), min(components, f.rank)
            z = x - np.array([s / f.n for s in f.sums])
            w = np.zeros((len(x), k))
            w[:, :kept] = z @ f.vectors[:, :kept] / np.sqrt(f.values[:kept])
            missing = np.broadcast_to(np.arange(k) >= kept, w.shape).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k, dtype=np.int32)),
                                             pa.array(w.reshape(-1), mask=missing))
            yield pa.record_batch([rows.column(0), rows.column(1), rows.column(2), rows.column(3),
                                   _deviations(x, f.n, f.sums), lists],
                                  names=["x", "dim", "count", "hash", "deviation", "whitened"])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = {}, TaskContext.get().partitionId()
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                kept = min(components, fits[dim].rank)
                if not kept:
                    continue
                r = b.filter(pa.array(dims == dim))
                w = r.column(0).flatten().fill_null(0.0).to_numpy().reshape(len(r), -1)[:, :kept]
                c = r.column(2).to_numpy() if weights == "counts" else np.ones(len(r), np.int64)
                mean = c @ w / c.sum()
                z = w - mean
                total[dim] = _merged(total.get(dim), (int(c.sum()), mean, (z * c[:, None]).T @ z))
        for dim, (n, mean, scatter) in total.items():
            yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([part], pa.int32()), pa.array([n]),
                                   pa.array([mean.tolist()]), pa.array([scatter.reshape(-1).tolist()])],
                                  names=["dim", "part", "n", "mean", "scatter"])

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        state = None
        for r in rows.sort_values("part").itertuples():
            state = _merged(state, (r.n, np.asarray(r.mean), np.asarray(r.scatter).reshape(len(r.mean), -1)))
        n, mean, scatter = state
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "error": [np.abs(scatter / n - np.eye(len(mean))).max()]})

    rows = distinct.where("dim > 0").select("x", "dim", "count", "hash")
    done = stored(rows.mapInArrow(run, "x array<long>, dim int, count long, hash long, deviation long, "
                                       "whitened array<double>"), "whiten-distinct-done")
    found = done.select("whitened", "dim", "count").mapInArrow(
        moments, "dim int, part int, n long, mean array<double>, scatter array<double>")
    errors = {r["dim"]: r["error"] for r in found.groupBy("dim").applyInPandas(gather, "dim int, error double").collect()}
    return done, {d: errors.get(d) for d in fits}


def _merged(a: tuple | None, b: tuple) -> tuple:
    """Pairwise merge of (n, mean, centred scatter)."""
    if a is None:
        return b
    n, delta = a[0] + b[0], b[1] - a[1]
    return n, a[1] + delta * (b[0] / n), a[2] + b[2] + np.outer(delta, delta) * (a[0] * (b[0] / n))


def whitened_rows(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                  components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), quantised(F.col(vector)).alias("x")).where(F.col("x").isNotNull())
    distinct = distinct_vectors(rows)
    fits = fit(distinct, weights)
    done, errors = whiten(distinct, fits, components, weights)
    total = distinct.agg(F.sum("count")).first()[0] or 0
    hot = F.col("count") > total / max(HOT_SHARE, shuffle_partitions(spark))
    result = done.select("x", "hash", F.size("x").alias("dim"), "deviation", "whitened", hot.alias("hot"))
    named = rows.withColumn("hash", F.xxhash64("x"))
    # The hot ones first, by broadcast; their rows then take no part in the shuffle.
    few = result.where("hot").drop("hot")
    marked = named.join(F.broadcast(few), ["hash", "x"], "left")
    out = marked.where(F.col("dim").isNotNull()).drop("x", "hash").unionByName(
        named.join(F.broadcast(few.select("hash", "x")), ["hash", "x"], "left_anti").join(
            result.where("not hot").drop("hot"), ["hash", "x"]).drop("x", "hash"))
    shares = [(d, k, f.n, float(f.values[k - 1] / f.trace) if f.trace > 0 else None, errors[d])
              for d, f in fits.items() for k in range(1, min(components, d) + 1)]
    # One row per length and component.
    about = spark.createDataFrame(shares, "dim int, component int, n long, explained double, identity_error double")
    out = out.select("vec_id", "dim", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.withColumn("component", F.col("at") + 1).join(F.broadcast(about), ["dim", "component"]).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(table(spark, sf_dir, "embeddings"))
