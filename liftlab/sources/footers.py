"""Facts of Parquet files from their footers, read on the executors.

One row per file, row group and column: rows, codec, encodings, sizes and statistics. No column
data is read. A task opens its files through pyarrow; where pyarrow does not know the
store, Spark's binary source hands it the file instead (up to 2 GB a file).
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = ("path string, size_bytes long, row_group int, row_group_rows long, column_name string, "
          "physical_type string, codec string, encodings array<string>, dictionary boolean, "
          "compressed_bytes long, uncompressed_bytes long, null_count long, minimum string, maximum string")
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def _columns(path: str, size: int, meta) -> Iterator[tuple]:
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            col = group.column(c)
            s = col.statistics if col.is_stats_set else None
            bounds = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
            yield (path, size, g, group.num_rows, col.path_in_schema, col.physical_type, col.compression,
                   list(col.encodings), bool(col.has_dictionary_page), col.total_compressed_size,
                   col.total_uncompressed_size, s.null_count if s is not None and s.has_null_count else None, *bounds)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq
    from pyarrow import fs
    for b in batches:
        out = []
        for r in b.itertuples():
            if "content" in b.columns:
                meta = pq.read_metadata(io.BytesIO(r.content))
            else:
                store, name = fs.FileSystem.from_uri(r.path)
                with store.open_input_file(name) as f:
                    meta = pq.ParquetFile(f).metadata
            out += _columns(r.path, r.length, meta)
        yield pd.DataFrame(out, columns=_NAMES)


def _opens(path: str) -> bool:
    from pyarrow import fs
    try:
        fs.FileSystem.from_uri(path)
    except Exception:  # an unknown scheme, or a store that is not reached from here
        return False
    return True


def parquet_footers(spark: SparkSession, path: str, *, glob: str = "*.parquet",
                    through_spark: bool | None = None) -> DataFrame:
    """Footers of all Parquet files below ``path``; ``through_spark`` forces the binary source."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", True).load(path))
    if through_spark is None:
        first = files.select("path").take(1)
        through_spark = bool(first) and not _opens(first[0]["path"])
    return files.select("path", "length", *(["content"] if through_spark else [])).mapInPandas(_read, SCHEMA)


def file_summary(footers: DataFrame) -> DataFrame:
    """Per file: rows, row groups, columns, bytes, codecs, and whether every column has statistics."""
    groups = footers.groupBy("path", "size_bytes", "row_group").agg(
        F.first("row_group_rows").alias("rows"), F.count(F.lit(1)).alias("columns"),
        F.collect_set("codec").alias("codecs"), F.min(F.col("minimum").isNotNull()).alias("bounded"))
    return groups.groupBy(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", "size_bytes").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("row_groups"), F.max("columns").alias("columns"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("codecs")))).alias("codecs"),
        F.min("bounded").alias("all_bounded")).drop("path")
