"""WARC segments: exact round trips, and damaged archives that are named as such."""

import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from liftlab.llm import warc

SF = "/root/testdata/sf0.01"


def round_trip(spark, tmp_path, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, payload binary").withColumns(
        {"sha1": F.lit("clash"), "block": F.lit(1), "refers_to": F.lit(2)})
    path = f"{tmp_path}/warc"
    warc.write_archives(df, path, **options)
    return path, warc.read_archives(spark, path)


@pytest.mark.parametrize("segment, chunk, files", [(1 << 16, 1 << 13, 1 << 14), (100, 7, 3)])
def test_payloads_survive(spark, tmp_path, segment, chunk, files):
    rnd = random.Random(4)
    big = rnd.randbytes(2000 if segment == 100 else 400_000)
    rows = [(1, "http://a/é?q=1 2\r\nX: y", "häß\r\n\r\nWARC/1.1\r\n".encode()), (2, None, big), (3, "u", None), (4, "u", b""),
            (5, "u", big), (None, "n", b"no id"), (None, "n", b"no id"), (7, "u", b"once"), (7, "u", b"once"), (8, "u", b"once"),
            (9, "z", b"\xff\xfe\x00\x80\r\n0\r\n\r\n"), (10, "w", b"x" * 200_000 if segment > 100 else b"x")]
    _, back = round_trip(spark, tmp_path, rows, records_per_file=files, segment_bytes=segment, http_chunk=chunk)
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"],
                  None if r["payload"] is None else bytes(r["payload"])) for r in back.collect())
    first = {}
    for i, _, p in rows:
        if i is not None:
            first[p or b""] = min(first.get(p or b"", i), i)
    want = []
    for i, _, p in rows:
        p = p or b""
        again = i is not None and first[p] != i
        sha = base64.b32encode(hashlib.sha1(p).digest()).decode()
        want.append((i or -1, "revisit" if again else "response", first[p] if again else None, len(p), sha, None if again else p))
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r)) or sorted(
        got, key=repr) == sorted(want, key=repr)
    assert all(r["problem"] is None for r in back.collect())
    assert max(r["segments"] for r in back.collect()) > 5


def test_small_payloads_may_stay_responses(spark, tmp_path):
    rows = [(1, "u", b"abc"), (2, "u", b"abc"), (3, "u", b"abcdef"), (4, "u", b"abcdef")]
    _, back = round_trip(spark, tmp_path, rows, revisit_bytes=4)
    assert {r["page_id"]: r["refers_to"] for r in back.collect()} == {1: None, 2: None, 3: None, 4: 3}


def damaged(spark, tmp_path, change):
    rec = list(warc.page_records("urn:a", 1, "u", b"q" * 300, None, 60))
    rec = change(rec)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in rec))
    return warc.read_archives(spark, f"{tmp_path}/d").collect()


def test_segments_out_of_order_and_in_two_files(spark, tmp_path):
    rec = list(warc.page_records("urn:a", 1, "u", b"q" * 300, None, 60))
    rec += list(warc.page_records("urn:b", 2, "u", b"r" * 200, None, 60))
    random.Random(2).shuffle(rec)
    (tmp_path / "d").mkdir()
    for i in (0, 1):
        data = b"".join(gzip.compress(r + b"\r\n\r\n") for r in rec[i::2])
        (tmp_path / "d" / f"{i}.warc.gz").write_bytes(data)
    got = {r["page_id"]: (bytes(r["payload"]), r["problem"]) for r in warc.read_archives(spark, f"{tmp_path}/d").collect()}
    assert got == {1: (b"q" * 300, None), 2: (b"r" * 200, None)}


@pytest.mark.parametrize("change, problem", [
    (lambda r: r[:-1], "last segment"), (lambda r: r[:2] + r[3:], "missing or repeated"),
    (lambda r: r + [r[2]], "missing or repeated"), (lambda r: r[1:], "missing or repeated"),
    (lambda r: [*r[:-1], r[-1].replace(b"Total-Length: ", b"Total-Length: 9")], "total length"),
    (lambda r: [r[0].replace(b"sha1:", b"sha1:A"), *r[1:]], "digest")])
def test_damage_is_named(spark, tmp_path, change, problem):
    got = damaged(spark, tmp_path, change)
    assert len(got) == 1 and problem in got[0]["problem"]


def test_a_file_that_ends_early(spark, tmp_path):
    got = damaged(spark, tmp_path, lambda r: [*r[:-1], r[-1][:-5]])
    assert got and got[0]["problem"]


def test_framing():
    for n in (0, 1, 9, 10, 4096, 5000):
        p = random.Random(n).randbytes(n)
        assert warc.unchunked(warc.chunked(p, 10)) == p
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    fields, block = next(warc.parse(io.BytesIO(b"WARC/1.0\r\nA: b\r\n c\r\nContent-Length: 2\r\n\r\nxy\r\n\r\n")))
    assert fields["a"] == "b c" and block == b"xy"


def test_empty_table(spark, tmp_path):
    _, back = round_trip(spark, tmp_path, [])
    assert back.count() == 0
