"""Atomic publishing. Immutable version folders, and a pointer that is written last.

    table/versions/<id>/       complete Parquet folders, never changed
    table/_pointers/<n>.json   names the versions that make up the table, and a checksum

A table changes by one small file that is created under a new number and never overwritten. Readers
take the pointer with the largest number whose checksum is right, so they see the old
or the new table whatever step a writer dies in; a half-written pointer counts as absent. Nothing
is renamed, so object stores copy nothing. Two writers cannot take the same number; the
second one looks again at what the first has published.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from liftlab.spec import ValidationError


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, content: bytes) -> bool:
    """Write a new small file; False if there is one of that name."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return False
    try:
        stream = fs.create(p, False)
    except Exception as error:  # another writer was first
        if fs.exists(p):
            return False
        raise ValidationError(f"{path} cannot be written: {error}") from error
    try:
        stream.write(content)
    finally:
        stream.close()
    return True


def _encoded(versions: list[str]) -> bytes:
    body = json.dumps(versions)
    return f"{zlib.crc32(body.encode())} {body}\n".encode()


def _decoded(content: bytes) -> list[str] | None:
    check, _, body = content.decode(errors="replace").partition(" ")
    if not body.endswith("\n") or str(zlib.crc32(body[:-1].encode())) != check:
        return None
    return json.loads(body)


def _pointers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all pointer files, largest first."""
    names = [n.partition(".") for n in _names(spark, f"{path}/_pointers")]
    return sorted((int(n) for n, _, kind in names if kind == "json" and n.isdigit()), reverse=True)


def current(spark: SparkSession, path: str) -> list[str]:
    """Versions that make up the table now; empty if nothing was published."""
    path = path.rstrip("/")
    for n in _pointers(spark, path):
        versions = _decoded(_read_bytes(spark, f"{path}/_pointers/{n}.json"))
        if versions is not None:
            return versions
    return []


def commit(spark: SparkSession, path: str, change: Callable[[list[str]], list[str]]) -> list[str]:
    """Publish ``change(versions now)``; it is called again if another writer comes between."""
    path = path.rstrip("/")
    while True:
        n = max(_pointers(spark, path), default=0) + 1
        versions = change(current(spark, path))
        if _create(spark, f"{path}/_pointers/{n}.json", _encoded(versions)):
            return versions


def stage(df: DataFrame, path: str, compression: str = "zstd") -> str:
    """Write a table as a version that no reader sees yet; returns its id."""
    version = uuid.uuid4().hex
    df.write.mode("error").option("compression", compression).parquet(f"{path.rstrip('/')}/versions/{version}")
    return version


def publish_table(df: DataFrame, path: str, *, append: bool = False, compression: str = "zstd") -> None:
    """Replace the table at ``path``, or add to it, in one step."""
    version = stage(df, path, compression)
    commit(df.sparkSession, path, lambda now: [*now, version] if append else [version])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The published table. A DataFrame keeps the versions it was made from."""
    versions = current(spark, path)
    if not versions:
        raise ValidationError(f"nothing is published at {path}")
    return spark.read.parquet(*[f"{path.rstrip('/')}/versions/{v}" for v in versions])


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete versions that the table no longer names (no reader or writer may be at work)."""
    path, keep = path.rstrip("/"), set(current(spark, path))
    gone = [v for v in _names(spark, f"{path}/versions") if v not in keep]
    for v in gone:
        fs, p = _fs(spark, f"{path}/versions/{v}")
        fs.delete(p, True)
    return gone
