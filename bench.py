"""Benchmark: headline operators at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

The experiment table is derived from the driver's tables and written once as
Parquet (the prepared table every analysis reads); each operator is then
timed end to end on that Parquet. Small results are collected; row-level
results are written to the ``noop`` sink so the whole plan runs without
moving rows to the driver. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from liftlab.operators import (balance, effects, population, power, ranking,  # noqa: E402
                               sampling, validate)
from liftlab.plans.experiment import analyze_experiment  # noqa: E402
from liftlab.plans.uplift import analyze_uplift  # noqa: E402
from liftlab.session import ensure_checkpoint_dir, get_spark  # noqa: E402
from liftlab.sources.ingest import prepare_dataset  # noqa: E402
from liftlab.sources.overlay import experiment_table, rule_scores  # noqa: E402
from liftlab.spec import ExperimentSpec  # noqa: E402

SPEC = ExperimentSpec()


def _collect_all(frames) -> None:
    for df in (frames.values() if isinstance(frames, dict) else frames):
        df.collect()


def _noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(cores=cpus, shuffle_partitions=2 * cpus, app="liftlab-bench")
    scratch = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}"
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    prepared = f"{scratch}/experiment.parquet"
    timed("materialize_experiment_table", lambda: experiment_table(spark, sf_dir)
          .write.option("compression", "zstd").parquet(prepared))
    df = spark.read.parquet(prepared)
    n_rows = df.count()

    timed("population_summary", lambda: population.population_summary(df, SPEC).collect())
    timed("itt_effects", lambda: effects.itt_effects(df, SPEC).collect())
    timed("itt_effects_by_segment", lambda: effects.itt_effects(df, SPEC, by=["f4"]).collect())
    timed("allocation_audit", lambda: effects.allocation_audit(df, SPEC).collect())
    timed("mde_grid", lambda: power.mde_grid(df, SPEC).collect())
    timed("sample_size_grid", lambda: power.sample_size_grid(df, SPEC).collect())
    timed("continuous_balance", lambda: balance.continuous_balance(df, SPEC).collect())
    timed("categorical_balance", lambda: balance.categorical_balance(df, SPEC).collect())
    timed("column_profile", lambda: validate.column_profile(df).collect())
    timed("binary_profile", lambda: validate.binary_profile(df, SPEC).collect())
    timed("logical_violations", lambda: validate.logical_violations(df, SPEC).collect())
    timed("duplicate_rows", lambda: validate.duplicate_rows(df).collect())
    timed("table_equivalence", lambda: validate.table_equivalence(
        df, validate.narrow_binaries(df, SPEC), SPEC).collect())

    def ranked():
        ev = ranking.RankedEvaluation(rule_scores(df), outcome="visit", outcome_name="visit")
        _collect_all([ev.gain_curve(), ev.auuc(), ev.targeting_policy(),
                      ev.uplift_deciles(), ev.cate_summary()])
        ev.release()
    timed("ranking_evaluation", ranked)
    timed("predictive_diagnostics", lambda: ranking.predictive_diagnostics(
        rule_scores(df), outcome="visit").collect())
    timed("sample_rows", lambda: _noop(sampling.sample_rows(df, max(1, n_rows // 2), 42)))
    timed("split_summary", lambda: sampling.split_summary(
        sampling.split_rows(df, 42, spec=SPEC), SPEC).collect())
    timed("experiment_report", lambda: _collect_all(analyze_experiment(df, SPEC)))
    timed("uplift_report", lambda: _collect_all(analyze_uplift(df, SPEC, parallelism=4)))

    raw = f"{scratch}/raw"
    numeric = df.select("id", "f0", "f2", "f7", "f10",
                        *[F.col(c).cast("double").alias(c) for c in ("f5", "f6", "f8", "f9", "f11")],
                        *SPEC.binaries)
    numeric.write.option("header", True).option("compression", "gzip").csv(raw)
    prep_spec = ExperimentSpec(
        features=("f0", "f2", "f7", "f10", "f5", "f6", "f8", "f9", "f11", "id"),
        continuous=("f0", "f2", "f7", "f10", "id"),
        categorical=("f5", "f6", "f8", "f9", "f11"))
    timed("prepare_dataset", lambda: _collect_all(prepare_dataset(
        spark, raw, f"{scratch}/prepared.parquet", spec=prep_spec)))

    total = round(sum(times.values()), 3)
    name = os.path.basename(sf_dir.rstrip("/"))
    try:
        sf: float | str = float(name.removeprefix("sf"))
    except ValueError:
        sf = name
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "rows": n_rows, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
