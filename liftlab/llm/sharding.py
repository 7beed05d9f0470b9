"""Shard a table along a Hilbert curve through its metadata.

Several metadata columns are quantised to cells of equal row counts, the cells
are numbered along a Hilbert curve, rows are sorted by (curve index, id) by
range, and the sorted table is cut into runs of equal row counts. Neighbours on
the curve are neighbours in every dimension, so the files of a run have narrow
minimum and maximum statistics in all of them and filters on any of the columns
prune files.

Numbers are quantised as doubles at approximate quantiles. Strings are quantised whole, in byte
order: their distinct values are counted, range-sorted and cut where the running count
passes an equal share of the rows.

Defined cases. A null value falls in the first cell of its dimension, and a value with many rows
takes the cells that its rows fill as one. Null and repeated ids sort like any other value (null first); rows equal in all sort columns take
consecutive slots. An empty table gives an empty result. Other columns are
carried through; hilbert, shard and slot replace columns of those names unless
``columns`` names the operator's own differently.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftlab.llm.common import fresh, ranked, shuffle_partitions, stored, table

SHARDS = 16
#: Cells per dimension: 2 ** BITS.
BITS = 5


def string_bounds(df: DataFrame, c: str, cells: int) -> list[str]:
    """At most ``cells - 1`` values, ascending, that cut the column's rows into equal shares.

    Distinct values are counted before anything is sorted, so a value with many rows is one row here.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    parts = shuffle_partitions(df.sparkSession)
    rows = stored(counts.repartitionByRange(parts, "value").sortWithinPartitions("value").withColumn(
        "at", F.monotonically_increasing_id()), "shard-values").withColumn("part", F.shiftright("at", 33))
    starts, total = [], 0
    for r in rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row per partition
        starts.append((r["part"], total))
        total += r["n"]
    if not total:
        return []
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("at")) + F.col("start")
    share = lambda x: F.floor(x * cells / total)
    cut = rows.join(F.broadcast(df.sparkSession.createDataFrame(starts, "part long, start long")), "part").select(
        "value", "n", upto.alias("upto")).where(
            (share(F.col("upto")) > share(F.col("upto") - F.col("n"))) & (F.col("upto") < total))
    return [r["value"] for r in cut.orderBy("value").collect()]


def string_cell(c: Column, bounds: Sequence[str]) -> Column:
    """Number of bounds below the value; null is in the first cell."""
    out = F.lit(0)
    for b in bounds:
        out = out + F.coalesce((c > F.lit(b)).cast("int"), F.lit(0))
    return out


def hilbert_index(cells: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each cell (one array per dimension).

    Walks from the top bit down: at each level, the bits of all dimensions
    name an orthant, and the axes below it are swapped or mirrored to that
    orthant's orientation; the Gray code of the orthants then gives the index.
    """
    x = [c.astype(np.int64).copy() for c in cells]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] >> level) & 1, flip ^ ((1 << level) - 1), flip)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ flip) >> level) & 1)
    return out


def with_hilbert(df: DataFrame, dims: Sequence[str], bits: int = BITS,
                 name: str = "hilbert") -> DataFrame:
    """Add the curve index of each row's cell.

    One scan finds the bounds of the cells of all numbers, and one each those of a string dimension.
    """
    kinds = dict(df.dtypes)
    names = fresh([*df.columns, name], *[f"_d{i}" for i in range(len(dims))])
    cells = 1 << bits
    text = {k: c for k, c in zip(names, dims) if kinds[c] == "string"}
    number = {k: F.col(c).cast("double") for k, c in zip(names, dims) if kinds[c] != "string"}
    cuts = [j / cells for j in range(1, cells)]
    found = df.select(*[v.alias(k) for k, v in number.items()]).agg(
        *[F.percentile_approx(k, cuts, 10_000).alias(k) for k in number]).first() if number else {}
    bounds = {k: np.unique(np.asarray(found[k] or [], dtype=np.float64)) for k in number}
    keys = {k: string_cell(F.col(text[k]), string_bounds(df, text[k], cells)).cast("double") if k in text else number[k]
            for k in names}

    @F.pandas_udf("long")
    def index(cols: pd.DataFrame) -> pd.Series:
        at = [(v := cols[k].to_numpy(np.float64)) if k not in bounds else
              np.where(np.isnan(v := cols[k].to_numpy(np.float64)), 0,
                       np.searchsorted(bounds[k], np.nan_to_num(v), side="left"))
              for k in cols.columns]
        return pd.Series(hilbert_index(at, bits))

    return df.withColumns(keys).withColumn(name, index(F.struct(*keys))).drop(*keys)


def shard_rows(df: DataFrame, dims: Sequence[str], tie: Sequence[str], shards: int = SHARDS,
               bits: int = BITS, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Add hilbert, shard and slot: runs of the curve order, counts at most one apart."""
    own = {c: c for c in ("hilbert", "shard", "slot")} | dict(columns or {})
    keyed = stored(with_hilbert(df, dims, bits, own["hilbert"]), "shard-keys")
    total = keyed.count()
    (rank,) = fresh([*keyed.columns, *own.values()], "_rank")
    r = ranked(keyed, [own["hilbert"], *tie], "shard-order", rank)
    shard = F.expr(f"`{rank}` * {shards} div {max(total, 1)}")
    first = F.expr(f"(cast(`{own['shard']}` as long) * {total} + {shards - 1}) div {shards}")
    return (r.withColumn(own["shard"], shard.cast("int"))
            .withColumn(own["slot"], F.col(rank) - first).drop(rank))


def write_shards(sharded: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder per shard, rows in slot order; large shards span several files.

    Rows are ranged on (shard, slot), so a file covers a run of the curve.
    """
    (sharded.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
     .write.partitionBy(shard).parquet(path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", (F.length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    docs = stored(docs, "shard-docs")  # narrow: the texts are read once
    s = shard_rows(docs, ["source", "lang", "size"], ["doc_id", "text_crc32"])
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "hilbert")
