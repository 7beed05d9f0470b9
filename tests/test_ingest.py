"""Prepare: end to end on a tiny gzip CSV, and its failure modes."""

import gzip
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from liftlab.sources.ingest import prepare_dataset, read_csv_header
from liftlab.spec import ValidationError

HEADER = "f0,f1,treatment,conversion,visit,exposure\n"


def _write(d, name, body, header=HEADER):
    path = os.path.join(d, name)
    with gzip.open(path, "wt") as fh:
        fh.write(header + body)
    return path


def test_prepare_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="run-")
    raw = _write(d, "raw.csv.gz", "1.5,10.0,1,1,1,1\n2.5,20.0,0,0,0,0\n1.5,10.0,1,1,1,1\n")
    out = os.path.join(d, "out.parquet")
    rep = prepare_dataset(spark, raw, out)
    s = rep["summary"].first()
    assert s.row_count == 3 and s.duplicate_full_rows == 1 and s.equivalence_passed
    assert all(r.passed for r in rep["equivalence"].collect())
    pq = spark.read.parquet(out)
    assert dict(pq.dtypes)["treatment"] == "tinyint"
    rows = pq.collect()
    assert len(rows) == 3 and sorted(rows)[0] == sorted(rows)[1]
    with pytest.raises(ValidationError, match="already exists"):
        prepare_dataset(spark, raw, out)
    prepare_dataset(spark, raw, out, overwrite=True)


def test_invalid_binary_leaves_no_output(spark):
    d = tempfile.mkdtemp(prefix="run-")
    raw = _write(d, "bad.csv.gz", "1.5,10.0,2,1,1,1\n2.5,20.0,0,0,0,0\n")
    out = os.path.join(d, "out.parquet")
    with pytest.raises(ValidationError, match="invalid binary values"):
        prepare_dataset(spark, raw, out)
    assert not os.path.exists(out) and not os.path.exists(out + ".part")


def test_missing_exposure_is_named(spark):
    d = tempfile.mkdtemp(prefix="run-")
    raw = _write(d, "raw.csv.gz", "1.5,10.0,1,1,1\n", header="f0,f1,treatment,conversion,visit\n")
    with pytest.raises(ValidationError, match="exposure"):
        prepare_dataset(spark, raw, os.path.join(d, "out.parquet"))


def test_duplicate_header_rejected(spark):
    d = tempfile.mkdtemp(prefix="run-")
    raw = _write(d, "raw.csv.gz", "1,1\n", header="a,a\n")
    with pytest.raises(ValidationError, match="duplicate"):
        read_csv_header(spark, raw)


def test_non_finite_values_fail(spark):
    d = tempfile.mkdtemp(prefix="run-")
    raw = _write(d, "raw.csv.gz", "NaN,10.0,1,1,1,1\n2.5,20.0,0,0,0,0\n")
    with pytest.raises(ValidationError, match="nonfinite"):
        prepare_dataset(spark, raw, os.path.join(d, "out.parquet"))


def test_file_manifest_checksums(spark):
    import hashlib
    from liftlab.sources.manifest import file_manifest
    d = tempfile.mkdtemp(prefix="run-")
    for name, body in (("a.bin", b"alpha"), ("b.bin", b"beta")):
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(body)
    expected = {"a.bin": hashlib.sha256(b"alpha").hexdigest().upper(), "b.bin": "0" * 64}
    got = {r.file_name: r for r in file_manifest(spark, d, expected=expected).collect()}
    assert got["a.bin"].size_bytes == 5 and got["a.bin"].checksum_matches
    assert not got["b.bin"].checksum_matches


def test_large_files_are_hashed_in_chunks(spark, tmp_path):
    import hashlib
    from liftlab.sources import manifest
    body = os.urandom(3 * manifest.CHUNK_BYTES + 17)
    (tmp_path / "big.bin").write_bytes(body)
    (tmp_path / "small.bin").write_bytes(b"x")
    got = {r.file_name: r.sha256 for r in manifest.file_manifest(spark, str(tmp_path), row_bytes=1000).collect()}
    assert got == {"big.bin": hashlib.sha256(body).hexdigest(), "small.bin": hashlib.sha256(b"x").hexdigest()}


def test_integers_keep_all_digits_and_floats_stay_floats(spark):
    d = tempfile.mkdtemp(prefix="run-")
    raw = _write(d, "raw.csv.gz", "9007199254740992,1.5,1,1,1,1\n9007199254740993,2,0,0,0,0\n,,0,0,0,0\n")
    rep = prepare_dataset(spark, raw, os.path.join(d, "out.parquet"))
    out = spark.read.parquet(os.path.join(d, "out.parquet"))
    assert dict(out.dtypes)["f0"] == "bigint" and dict(out.dtypes)["f1"] == "double"
    assert {r.f0 for r in out.collect()} == {9007199254740992, 9007199254740993, None}
    assert rep["summary"].first().duplicate_full_rows == 0


def test_every_bad_column_is_named_before_anything_is_written(spark):
    d = tempfile.mkdtemp(prefix="run-")
    raw = _write(d, "raw.csv.gz", "a,1,300,1,0.5,1\nb,2,0,0,0,0\n")
    with pytest.raises(ValidationError) as e:
        prepare_dataset(spark, raw, os.path.join(d, "out.parquet"))
    assert all(n in str(e.value) for n in ("f0", "treatment", "300", "visit", "0.5"))
    assert os.listdir(d) == ["raw.csv.gz"]


def test_a_failed_rename_keeps_the_old_table(spark, monkeypatch):
    from liftlab.sources import ingest
    d = tempfile.mkdtemp(prefix="run-")
    out = os.path.join(d, "out.parquet")
    prepare_dataset(spark, _write(d, "a.csv.gz", "1.5,10.0,1,1,1,1\n2.5,20.0,0,0,0,0\n"), out)
    real = ingest.rename_path

    def broken(session, src, dst):
        if src.endswith(ingest.STAGING_SUFFIX):
            raise ValidationError("rename refused")
        real(session, src, dst)

    monkeypatch.setattr(ingest, "rename_path", broken)
    with pytest.raises(ValidationError, match="refused"):
        prepare_dataset(spark, _write(d, "b.csv.gz", "7.5,10.0,1,1,1,1\n"), out, overwrite=True)
    assert spark.read.parquet(out).count() == 2
    assert spark.read.parquet(out + ingest.STAGING_SUFFIX).count() == 1  # checked, and kept


def test_a_table_without_ids_goes_through_both_reports(spark, tmp_path):
    from liftlab.plans.experiment import analyze_experiment
    from liftlab.plans.uplift import analyze_uplift
    from liftlab.sources.overlay import experiment_table
    df = experiment_table(spark, "/root/testdata/sf0.001").drop("id")
    codes = [F.conv(F.substring(F.md5(F.col(c)), 1, 4), 16, 10).alias(c) for c in ("f1", "f3", "f4")]
    df.select(*[c for c in df.columns if c not in ("f1", "f3", "f4")], *codes).coalesce(1).write.option(
        "header", True).option("compression", "gzip").csv(f"{tmp_path}/raw")
    prepare_dataset(spark, f"{tmp_path}/raw", f"{tmp_path}/t.parquet")
    table = spark.read.parquet(f"{tmp_path}/t.parquet")
    assert "id" not in table.columns
    rep = analyze_experiment(table)
    assert rep["population"].first().total_count == 1473 and rep["treatment_predictability"].count() == 1
    up = analyze_uplift(table, outcomes=["visit"], learner_names=("t_learner",), max_iterations=5)
    assert sum(r.observations for r in up["split_summary"].collect()) == 1473


def _events(spark, folder, run):
    """Plans and stages of a run, from the event log of a session of its own."""
    import json
    import subprocess
    import sys
    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
s = (SparkSession.builder.master('local[2]').config('spark.eventLog.enabled', 'true').config('spark.ui.enabled', 'false')
     .config('spark.eventLog.dir', 'file://{folder}').config('spark.sql.shuffle.partitions', '4')
     .config('spark.eventLog.compress', 'false').config('spark.eventLog.rolling.enabled', 'false').getOrCreate())
from liftlab.sources.ingest import prepare_dataset
{run}
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=300)
    (log,) = os.listdir(folder)
    with open(os.path.join(folder, log)) as fh:
        return [json.loads(line) for line in fh]


def test_one_csv_scan_and_no_exchange_of_text(spark, tmp_path):
    body = "".join(f"{i}.5,{i % 7},{i % 2},0,1,0\n" for i in range(2000))
    raw = _write(str(tmp_path), "raw.csv.gz", body)
    (tmp_path / "log").mkdir()
    log = _events(spark, str(tmp_path / "log"), f"prepare_dataset(s, {raw!r}, {str(tmp_path / 'out')!r})")
    plans = [e["physicalPlanDescription"] for e in log if e["Event"].endswith("SparkListenerSQLExecutionStart")]
    scans = [p for p in plans if "Scan csv" in p]
    assert len(scans) == 1 and "Exchange" not in scans[0]
    # Only the one row of counts per task is exchanged, no text.
    texts = [p for p in plans if "Scan parquet" in p and "-text" in p]
    assert texts and all(set(re.findall(r"Arguments: (\w+partitioning|SinglePartition)", p)) <= {"SinglePartition"} for p in texts)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2000
    assert not os.path.exists(str(tmp_path / "out") + ".part-text")


def test_bad_values_are_listed_with_their_rows(spark):
    d = tempfile.mkdtemp(prefix="run-")
    raw = _write(d, "raw.csv.gz", "x,1,2,1,0.5,1\nx,2,2,0,0,0\ny,3,7,0,0,0\n1,4,0,0,,0\n")
    with pytest.raises(ValidationError) as e:
        prepare_dataset(spark, raw, os.path.join(d, "out.parquet"))
    assert all(t in str(e.value) for t in ("f0: x in 2 rows, y in 1 rows", "treatment: 2 in 2 rows, 7 in 1 rows", "visit: 0.5 in 1 rows"))


def test_a_given_schema_must_fit(spark):
    from pyspark.sql import types as T
    d = tempfile.mkdtemp(prefix="run-")
    raw = _write(d, "raw.csv.gz", "1.5,1,1,1,1,1\n2,2,0,0,0,0\n")
    kinds = {n: T.LongType() for n in HEADER.strip().split(",")}
    with pytest.raises(ValidationError, match="f0 has 1 values that are no bigint.*1.5 in 1 rows"):
        prepare_dataset(spark, raw, os.path.join(d, "out"), schema=T.StructType([T.StructField(n, t) for n, t in kinds.items()]))
    kinds["f0"] = T.FloatType()
    prepare_dataset(spark, raw, os.path.join(d, "out"), schema=T.StructType([T.StructField(n, t) for n, t in kinds.items()]))
    assert dict(spark.read.parquet(os.path.join(d, "out")).dtypes)["f0"] == "float"


def test_versioned_tables_are_replaced_in_one_step(spark):
    from liftlab.sources import versioned
    d = tempfile.mkdtemp(prefix="run-")
    out = os.path.join(d, "table")
    prepare_dataset(spark, _write(d, "a.csv.gz", "1.5,10.0,1,1,1,1\n2.5,20.0,0,0,0,0\n"), out, versioned=True)
    before = versioned.read_table(spark, out)
    with pytest.raises(ValidationError, match="already exists"):
        prepare_dataset(spark, _write(d, "b.csv.gz", "7.5,10.0,1,1,1,1\n"), out, versioned=True)
    with pytest.raises(ValidationError, match="invalid binary"):
        prepare_dataset(spark, _write(d, "c.csv.gz", "7.5,10.0,3,1,1,1\n"), out, versioned=True, overwrite=True)
    assert versioned.read_table(spark, out).count() == 2
    prepare_dataset(spark, os.path.join(d, "b.csv.gz"), out, versioned=True, overwrite=True)
    assert versioned.read_table(spark, out).count() == 1 and before.count() == 2


def test_manifest_names_nested_files_by_their_path(spark, tmp_path):
    import hashlib
    from liftlab.sources.manifest import file_manifest
    for folder in ("a", "b/c"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "same.bin").write_bytes(folder.encode())
    want = {"a/same.bin": hashlib.sha256(b"a").hexdigest(), "b/c/same.bin": hashlib.sha256(b"b/c").hexdigest()}
    for row_bytes in (0, 1 << 28):
        got = file_manifest(spark, str(tmp_path), expected=want, row_bytes=row_bytes).collect()
        assert {r.file_name: r.sha256 for r in got} == want and all(r.checksum_matches for r in got)
    assert [r.file_name for r in file_manifest(spark, str(tmp_path / "a" / "same.bin")).collect()] == ["same.bin"]


def test_row_ids_tell_folders_apart(spark, tmp_path):
    from liftlab.sources.ingest import with_row_id
    for folder in ("a", "b"):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / folder))
        (part,) = (tmp_path / folder).glob("part-*.parquet")
        part.rename(tmp_path / folder / "part-same.parquet")
    df = spark.read.parquet(str(tmp_path / "a"), str(tmp_path / "b")).withColumnRenamed("id", "x")
    assert with_row_id(df).select("id").distinct().count() == 6
