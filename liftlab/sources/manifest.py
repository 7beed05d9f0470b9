"""File manifest with SHA-256 checksums, compared to an expected list.

Files are listed without reading them; each is then hashed by one task in
bounded chunks, whatever its size. Comparison is case-insensitive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files up to this size are hashed in the JVM, in one row of the binary source.
ROW_BYTES = 1 << 28
CHUNK_BYTES = 1 << 23


def _hash_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of large files, read in chunks through their file system."""
    from pyarrow import fs
    for b in batches:
        digests = []
        for path in b["path"]:
            store, name = fs.FileSystem.from_uri(path)
            sha = hashlib.sha256()
            with store.open_input_stream(name) as stream:
                while chunk := stream.read(CHUNK_BYTES):
                    sha.update(chunk)
            digests.append(sha.hexdigest())
        yield b.assign(sha256=digests)


def _below(spark: SparkSession, path: str) -> Column:
    """The file's path below the folder ``path`` (its name, if ``path`` is the file or a pattern)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    name = F.element_at(F.split("path", "/"), -1)
    if not fs.exists(root) or not fs.getFileStatus(root).isDirectory():
        return name
    # Listed paths may write their scheme with more slashes than the folder's own.
    inner = fs.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    rest = F.substring_index("path", inner, -1)
    return F.when(F.contains("path", F.lit(inner)), rest).otherwise(name)


def file_manifest(spark: SparkSession, path: str, *, glob: str | None = None,
                  expected: Mapping[str, str] | DataFrame | None = None,
                  row_bytes: int = ROW_BYTES) -> DataFrame:
    """One row per file: name, byte size, SHA-256 and, if given, the match.

    A file is named by its path below ``path``, so files of one name in several folders stay
    apart. Files of at most ``row_bytes`` are read by Spark's binary source, which
    opens any store that Spark reads. Larger ones do not fit a row and are
    streamed by path on the executors.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    # The length filter is pushed to the listing: contents of large files are never read here.
    small = files.where(F.col("length") <= row_bytes).select(
        "path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > row_bytes).select("path", "length").mapInPandas(
        _hash_chunks, "path string, length long, sha256 string")
    out = small.unionByName(large).select(
        _below(spark, path).alias("file_name"),
        F.col("length").alias("size_bytes"), "sha256")
    if expected is None:
        return out
    if not isinstance(expected, DataFrame):
        expected = spark.createDataFrame(list(expected.items()),
                                         "file_name string, expected_sha256 string")
    joined = out.join(expected, "file_name", "full_outer")
    return joined.select(
        "file_name", "size_bytes", "sha256", "expected_sha256",
        F.coalesce(F.lower("sha256") == F.lower(F.trim("expected_sha256")),
                   F.lit(False)).alias("checksum_matches"))
