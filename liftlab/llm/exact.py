"""Exact duplicates by an extendible-hash index on shared files.

* Segments. A scan task writes, for every Arrow batch, one entry per different text
  (told apart by their bytes): the text, its SHA-256, the key (the digest's leading
  bits), and the ids of the batch's rows that hold it. Copies are thus folded before
  anything is shuffled, and a text's rows are never brought together.
* Directory. 2^G pointers, by the key's leading G bits, to buckets of a local
  depth. A bucket above its capacity is split by its next bit; where its depth is
  already G, the directory doubles. A bucket that no bit splits (one key) or that is still
  overfull at MAX_DEPTH gets overflow pages instead.
* Owners. One task per bucket (or page of a bucket) reads that key range's entries, sorted by key.
  Entries of one key form a chain of different texts; each is compared with the chain
  byte by byte. The task streams: it holds the chain of one key at a time.
  The heads of a paged bucket's chains are entries again and go through the same steps
  until no bucket has pages. Pages hold eight entries or more on average, so that ends.
* The classes are joined back to the segments by entry, and the ids are unfolded.

``build`` returns the three tables, each stored below ``spark.checkpoint.dir``.
The directory has at most 2^MAX_DEPTH pointers and goes to the tasks as one array
(4 MB at most); the driver sees its histogram, of as many rows at most.

Defined cases. Null text: the empty text, equal to it. Null doc_id: below every
other; a group of nulls alone has a null keep_id. Repeated rows or ids: every row is
returned, exactly one row of a group is kept, and it has the largest id. Very long texts are
compared whole. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlab.llm.common import raw_strings, shuffle_partitions, stored, table

#: Bytes of text in a bucket, at most, unless MAX_BUCKETS asks for more.
BUCKET_BYTES = 32 << 20
#: Small inputs are cut to this, so that all tasks have a part.
LEAST_BYTES = 1 << 20
MAX_BUCKETS = 1 << 16
MAX_DEPTH = 20
KEY_BITS = 64
#: Bytes that an entry counts for beside its text.
ENTRY_BYTES = 64
PAGE_ENTRIES = 8

ENTRIES = ("entry long, key long, n_bytes long, sha binary, text binary, ids array<long>, "
           "top long, size long, winner long")
MERGED = "entry long, head long, chain int, top long, size long, winner long, paged boolean"


class Index(NamedTuple):
    """segments: ENTRIES; directory: one row per bucket; classes: MERGED, one row per entry."""
    segments: DataFrame
    directory: DataFrame
    classes: DataFrame


def write_segments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   key_bits: int = KEY_BITS) -> DataFrame:
    """Stored entries of every batch: its different texts with the ids that hold them, ascending."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = TaskContext.get().partitionId() << 33
        for b in batches:
            if not len(b):
                continue
            ids, folded = b.column(0), b.column(1).dictionary_encode()
            code = folded.indices.to_numpy(zero_copy_only=False)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), known, code))
            n = len(folded.dictionary)
            bounds = np.searchsorted(code[order], np.arange(n + 1)).astype(np.int32)
            ends, data = raw_strings(folded.dictionary.cast(pa.large_binary()))
            shas = [hashlib.sha256(data[s:e]).digest() for s, e in zip(ends.tolist(), ends[1:].tolist())]
            key = np.array([int.from_bytes(d[:8], "big") >> (64 - key_bits) << (64 - key_bits)
                            for d in shas], dtype=np.uint64).view(np.int64)
            ids = ids.take(pa.array(order))
            numbers = pa.array(np.arange(entry, entry + n))
            entry += n
            yield pa.record_batch(
                [numbers, pa.array(key), pa.array(np.diff(ends)), pa.array(shas, pa.binary()),
                 folded.dictionary, pa.ListArray.from_arrays(pa.array(bounds), ids),
                 ids.take(pa.array(bounds[1:] - 1)), pa.array(np.diff(bounds).astype(np.int64)), numbers],
                names=["entry", "key", "n_bytes", "sha", "text", "ids", "top", "size", "winner"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, ENTRIES), "exact-segments")


class Directory:
    """Pointers by leading bits of the key; buckets with depth, load and pages."""

    def __init__(self, loads: np.ndarray, rows: np.ndarray, lone: np.ndarray, capacity: int) -> None:
        """``loads``, ``rows``, ``lone`` (holds one key at most): per prefix of the finest depth."""
        finest = len(loads).bit_length() - 1
        before, count = (np.concatenate([[0], np.cumsum(x)]) for x in (loads, rows))
        kinds = np.concatenate([[0], np.cumsum(np.where(rows > 0, np.where(lone, 1, 2), 0))])
        self.depth, self.pointers = 0, np.zeros(1, np.int32)
        first, local = [0], [0]  # of each bucket: its first finest prefix, its depth

        def part(b: int) -> tuple[int, int]:
            return first[b], first[b] + (1 << (finest - local[b]))

        full = [0]
        while full:
            b = full.pop()
            lo, hi = part(b)
            # One key cannot be split, and the finest prefix not further.
            if before[hi] - before[lo] <= capacity or kinds[hi] - kinds[lo] <= 1 or local[b] == finest:
                continue
            if local[b] == self.depth:  # the directory doubles
                self.depth += 1
                self.pointers = np.repeat(self.pointers, 2)
            local[b] += 1
            middle = part(b)[1]
            first.append(middle)
            local.append(local[b])
            shift = finest - self.depth
            self.pointers[middle >> shift:hi >> shift] = len(first) - 1
            full += [b, len(first) - 1]
        ends = np.array([part(b)[1] for b in range(len(first))])
        self.first, self.local = np.array(first), np.array(local)
        self.bytes, self.rows = before[ends] - before[self.first], count[ends] - count[self.first]
        self.overfull = [b for b in range(len(first)) if self.bytes[b] > capacity and local[b] == finest
                         and kinds[ends[b]] - kinds[first[b]] > 1]
        self.pages = np.maximum(1, np.minimum(-(-self.bytes // capacity), self.rows // PAGE_ENTRIES))
        # Units (pages of buckets) are numbered along the key ranges.
        along = np.argsort(self.first)
        self.start = np.zeros(len(first), np.int64)
        self.start[along] = np.concatenate([[0], np.cumsum(self.pages[along])[:-1]])
        self.units = int(self.pages.sum())

    def unit(self, key: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owner of each entry, and whether its bucket has pages."""
        slot = key.view(np.uint64) >> np.uint64(64 - self.depth) if self.depth else np.zeros(len(key), np.int64)
        bucket = self.pointers[slot.astype(np.int64)]
        pages = self.pages[bucket]
        mixed = (entry.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.start[bucket] + mixed.astype(np.int64) % pages, pages > 1


def make_directory(entries: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> Directory:
    spark = entries.sparkSession
    load = F.col("n_bytes") + F.lit(ENTRY_BYTES)
    total = entries.agg(F.sum(load)).first()[0] or 0
    capacity = max(min(bucket_bytes, max(total // shuffle_partitions(spark), LEAST_BYTES)), total // MAX_BUCKETS, 1)
    bits = min(MAX_DEPTH, max(1, (total // capacity).bit_length() + 2))
    while True:
        counts = entries.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("prefix")).agg(
            F.sum(load).alias("load"), F.count(F.lit(1)).alias("rows"),
            (F.min("key") == F.max("key")).alias("lone")).toArrow()
        prefix = counts["prefix"].to_numpy()
        loads, rows = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        lone = np.zeros(1 << bits, bool)
        loads[prefix], rows[prefix] = counts["load"].to_numpy(), counts["rows"].to_numpy()
        lone[prefix] = counts["lone"].to_numpy()
        out = Directory(loads, rows, lone, capacity)
        if not out.overfull or bits == MAX_DEPTH:
            return out
        bits = min(MAX_DEPTH, bits + 4)


class _Chain:
    """Entries of one key: different texts with their members so far."""

    def __init__(self, key: int) -> None:
        self.key, self.links = key, []

    def add(self, entry: int, text: bytes, top: int | None, size: int, winner: int, paged: bool) -> None:
        for link in self.links:
            if link[0] == text:
                link[1].append(entry)
                link[3] += size
                if (top is not None, top or 0, -winner) > (link[2] is not None, link[2] or 0, -link[4]):
                    link[2], link[4] = top, winner
                return
        self.links.append([text, [entry], top, size, winner, paged])

    def rows(self) -> Iterator[tuple]:
        for n, (_, members, top, size, winner, paged) in enumerate(self.links):
            for e in members:
                yield e, members[0], n, top, size, winner, paged


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, key, text, top, size, winner, paged) sorted by key -> MERGED."""
    names = [f.split()[0] for f in MERGED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    held = None
    for b in batches:
        if not len(b):
            continue
        key = b.column(1).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        long, out = np.diff(starts) > 1, []
        long[[0, -1]] = True  # may go on from the last batch, or into the next
        for r in np.flatnonzero(long):
            if held is None or held.key != key[starts[r]]:
                out += held.rows() if held else ()
                held = _Chain(int(key[starts[r]]))
            rows = b.slice(starts[r], starts[r + 1] - starts[r])
            for entry, text, top, size, winner, paged in zip(*(rows.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6))):
                held.add(entry, text, top, size, winner, paged)
        alone = b.take(pa.array(starts[:-1][~long]))
        if len(alone):
            entry = alone.column(0)
            yield pa.record_batch([entry, entry, pa.array(np.zeros(len(alone), np.int32)), *(
                alone.column(i) for i in (3, 4, 5, 6))], names=names)
        if out:
            yield batch(out)
    if held:
        yield batch(list(held.rows()))


def merge_entries(entries: DataFrame, directory: Directory) -> DataFrame:
    """Stored MERGED: the class of every entry within its owner's key range."""
    @F.pandas_udf("struct<unit:int, paged:boolean>")
    def owner(key: pd.Series, entry: pd.Series) -> pd.DataFrame:
        unit, paged = directory.unit(key.to_numpy(), entry.to_numpy())
        return pd.DataFrame({"unit": unit.astype(np.int32), "paged": paged})

    rows = entries.select("entry", "key", "text", "top", "size", "winner",
                          owner("key", "entry").alias("o"))
    rows = rows.select("entry", "key", "text", "top", "size", "winner", "o.paged", "o.unit")
    rows = rows.repartitionById(max(1, directory.units), F.col("unit")).drop("unit")
    return stored(rows.sortWithinPartitions("key", "entry").mapInArrow(_merge, MERGED), "exact-classes")


def classes(entries: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, Directory]:
    """MERGED of all entries, with the classes' totals; and the first directory."""
    directory = make_directory(entries, bucket_bytes)
    merged = merge_entries(entries, directory)
    if (directory.pages == 1).all():
        return merged, directory
    paged = merged.where("paged")
    heads = paged.where("entry = head").select("entry", "top", "size", "winner").join(
        entries.select("entry", "key", "n_bytes", "text"), "entry")
    final, _ = classes(stored(heads, "exact-heads"), bucket_bytes)
    moved = paged.select("entry", F.col("head").alias("via")).join(
        final.withColumnRenamed("entry", "via"), "via").select(merged.columns)
    return merged.where("not paged").unionByName(moved), directory


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          bucket_bytes: int = BUCKET_BYTES, key_bits: int = KEY_BITS) -> Index:
    segments = write_segments(docs, doc_id, text, key_bits)
    found, d = classes(segments, bucket_bytes)
    finest = max(1, int(d.local.max()))
    rows = [(b, int(d.first[b]), int(d.local[b]), int(d.bytes[b]), int(d.rows[b]), int(d.pages[b]))
            for b in range(len(d.first))]
    buckets = docs.sparkSession.createDataFrame(
        rows, "bucket int, first long, depth int, n_bytes long, entries long, pages long")
    return Index(segments, stored(buckets.coalesce(1), f"exact-directory-{finest}"), found)


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               bucket_bytes: int = BUCKET_BYTES, key_bits: int = KEY_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    index = build(docs, doc_id, text, bucket_bytes, key_bits)
    rows = index.segments.select("entry", "sha", "ids").join(
        index.classes.select("entry", "top", F.col("size").alias("group_size"), "winner"), "entry")
    rows = rows.select("*", F.posexplode("ids").alias("at", "doc_id"))
    kept = (F.col("entry") == F.col("winner")) & (F.col("at") == F.size("ids") - 1)
    return rows.select("doc_id", F.col("top").alias("keep_id"), "group_size", kept.alias("kept"),
                       F.lower(F.hex("sha")).alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


def oracle() -> str:
    return """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))"""
