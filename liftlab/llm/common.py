"""Helpers shared by the corpus operators: tables, scratch tables, global order, words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlab.session import ensure_checkpoint_dir

#: Whitespace between words; every other character belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column) -> Column:
    """Words of a text, in order; an empty array for null and for blank texts."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE), "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs only a reread of its files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: Sequence[str], *names: str) -> list[str]:
    """Names for helper columns that no column of a table has, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ranked(df: DataFrame, order: Sequence[str], name: str, rank: str = "rank") -> DataFrame:
    """Add each row's position (from 0) in the total order of ``order``.

    Range partitions are sorted and stored with their partition and position;
    the offsets of the partitions (one row per shuffle partition) are then
    joined. No window runs over all rows. Rows that tie in every column of
    ``order`` get distinct positions among themselves. ``df`` should be a
    stored, narrow table: range partitioning samples it first.
    """
    spark = df.sparkSession
    at, part, start = fresh([*df.columns, rank], "_at", "_part", "_start")
    rows = (df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
            .withColumn(at, F.monotonically_increasing_id()))
    rows = stored(rows, name).withColumn(part, F.shiftright(at, 33))
    offsets, total = [], 0
    for r in rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy(part).collect():
        offsets.append((r[part], total))
        total += r["n"]
    starts = spark.createDataFrame(offsets, f"{part} long, {start} long")
    return (rows.join(F.broadcast(starts), part)
            .withColumn(rank, F.col(start) + F.col(at).bitwiseAND((1 << 33) - 1))
            .drop(part, at, start))


#: Text that a task holds as words at a time, in bytes.
CHUNK_BYTES = 1 << 23


def chunks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK_BYTES of text each, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size.astype(np.int64)) // CHUNK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


#: Bytes of a text with every blank as a space, and A-Z lower-cased.
_SAME = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
_LOWER = _SAME.lower()


def raw_strings(a: pa.Array) -> tuple[np.ndarray, bytes]:
    """Bounds and bytes of a large_string array."""
    if not len(a):
        return np.zeros(1, dtype=np.int64), b""
    ends = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset:a.offset + len(a) + 1]
    data = a.buffers()[2]
    return ends - ends[0], data.slice(ends[0], ends[-1] - ends[0]).to_pybytes() if data else b""


def coded_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of all texts in order (A-Z lower-cased): codes, each text's bounds, words by code.

    A word's code is its place among the distinct words. Null texts are empty.
    """
    ends, data = raw_strings(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(
        data.translate(_LOWER if lower else _SAME)))
    lists = pc.split_pattern(flat, " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    found = lists.flatten().dictionary_encode()
    code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends, data = raw_strings(found.dictionary)
    ends = ends.tolist()
    names = [data[a:b] for a, b in zip(ends, ends[1:])]
    if b"" in names:  # beside a leading, trailing or further blank
        keep = code != names.index(b"")
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        code = code[keep]
    return code, bounds - bounds[0], names
