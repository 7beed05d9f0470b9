"""The uplift report as a set of DataFrames.

Flow: optional exact sample (the reference samples 2,000,000 rows for
local memory; on Spark the default is every row) -> stratified 60/20/20
split -> preprocessing fitted on train -> per outcome and learner: fit each
regularisation candidate on train, select by validation AUUC, evaluate once
on test.

The model columns are persisted (MEMORY_AND_DISK) for checks, split and
encoders and released when the transformed splits, which every fit and
evaluation reuses, are persisted too. A split depends on seed and id alone, so a
lost executor's partitions are recomputed to the same rows. The returned
tables are small local relations; the persisted data is released before
returning.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlab.operators import effects, learners, sampling
from liftlab.operators.ranking import require_unique_ids
from liftlab.plans import charts
from liftlab.session import small_table
from liftlab.sources.ingest import with_row_id
from liftlab.spec import ExperimentSpec, ValidationError

LEARNER_NAMES = ("s_learner", "t_learner")
#: Training rows of the fits that run at once, about: each fit keeps its own copy of its rows.
FIT_ROWS_AT_ONCE = 40_000_000
#: What each table rests on, for readers of the report.
METHODS = (
    ("split", "60/20/20 by a hash of the id within assignment and outcomes"),
    ("learners", "one penalised logistic model with assignment interactions, and one per arm"),
    ("selection", "largest area between policy and random gain on the validation rows"),
    ("signal", "outcome weighted by the inverse propensity of the arm that was assigned"),
    ("policy", "observed arm difference among the top ranked rows, hybrid score interval"),
)
LIMITATIONS = (
    "Scores rank units by a model; the effect of a unit is never observed.",
    "Tables use the test rows once, after selection on the validation rows.",
    "Top groups with few control events carry a flag and wide intervals.",
    "Rows count as independent units: the table names no clusters.",
)


def analyze_uplift(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(), *,
                   sample_size: int | None = None, seed: int = 42,
                   max_iterations: int = learners.DEFAULT_MAX_ITERATIONS,
                   alphas: Sequence[float] = learners.REGULARIZATION_CANDIDATES,
                   learner_names: Sequence[str] = LEARNER_NAMES,
                   outcomes: Sequence[str] | None = None,
                   classifier: learners.ClassifierFactory | None = None,
                   parallelism: int = 1, level_tables: bool = False,
                   approximate_quantiles: bool = False) -> dict[str, DataFrame]:
    """C5. ``parallelism`` > 1 runs the independent fits and evaluations as concurrent Spark
    jobs from driver threads (as ``CrossValidator(parallelism=...)`` does); results do not
    depend on it. All candidates are compared by one sort. ``level_tables`` keeps levels of
    categorical features off the driver; ``approximate_quantiles`` sketches the CATE quantiles."""
    started = time.perf_counter()
    if parallelism < 1:
        raise ValueError("parallelism must be at least 1")
    if max_iterations <= 0:
        raise ValueError(f"max_iterations must be at least 1, not {max_iterations}")
    outcomes = list(outcomes or spec.outcomes)
    if not learner_names:
        raise ValidationError("name at least one learner")
    spark = df.sparkSession
    spec.require_columns(df, spec.model_columns)
    df = with_row_id(df, spec.id)
    spec.validate_model_features(list(spec.features))
    whole = df.select(spec.id, *spec.model_columns).persist(StorageLevel.MEMORY_AND_DISK)
    require_unique_ids(whole, spec.id)
    source_rows = whole.count()
    base = whole if sample_size is None else sampling.sample_rows(
        whole, sample_size, seed, id_col=spec.id, on_oversize="error")
    split = sampling.split_rows(base, seed, spec=spec)
    parts = {name: split.where(F.col("split") == name) for name in ("train", "validation", "test")}
    pre = learners.fit_preprocessor(parts["train"], spec, level_tables)
    keep = [spec.id, spec.treatment, *spec.outcomes]
    matrices = {name: learners.transform_features(pre, p, keep).persist(
        StorageLevel.MEMORY_AND_DISK) for name, p in parts.items()}

    full_itt = {r["outcome"]: r["absolute_risk_difference"]
                for r in effects.itt_effects(whole, replace(spec, exposure=None)).select(
                    "outcome", "absolute_risk_difference").collect()}  # one row per outcome

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    # Small tables that fill the persisted matrices; the columns behind these are then given back,
    # so that their memory serves the fits.
    design = small_table(union([learners.design_size(m).select(F.lit(n).alias("split"), "*")
                                for n, m in matrices.items()]))
    split_summary = small_table(sampling.split_summary(split, spec))
    whole.unpersist()
    train_rows = design.where("split = 'train'").first()["rows"]
    at_once = min(2 * parallelism, max(1, FIT_ROWS_AT_ONCE // max(train_rows, 1))) if parallelism > 1 else 1

    tasks = [(outcome, name) for outcome in outcomes for name in learner_names]
    models = learners.fit_candidates(tasks, matrices["train"], spec=spec, alphas=alphas,
                                     max_iterations=max_iterations, classifier=classifier,
                                     parallelism=at_once)
    chosen = learners.choose(models, matrices["validation"], spec)

    def evaluate(task: tuple[str, str]) -> learners.ModelReport:
        rep = learners.evaluate_model(chosen[task], matrices["test"], spec=spec,
                                      full_benchmark_itt=full_itt.get(task[0]),
                                      approximate_quantiles=approximate_quantiles)
        # held-out tables are small (<= ~120 rows): compute them in this thread
        rep.tables = {k: (t if k == "scores" else small_table(t)) for k, t in rep.tables.items()}
        return rep

    if parallelism > 1 and len(tasks) > 1:
        with ThreadPoolExecutor(max_workers=min(parallelism, len(tasks))) as pool:
            done = list(pool.map(evaluate, tasks))
    else:
        done = [evaluate(t) for t in tasks]

    reports, curves, policies = [], {}, {}
    tables: dict[str, list[DataFrame]] = {}
    for (outcome, name), rep in zip(tasks, done):
        reports.append(rep)
        curves[(outcome, name)] = rep.tables["gain_curve"]
        policies[(outcome, name)] = rep.tables["targeting_policy"]
        for key, t in rep.tables.items():
            if key == "scores":
                continue
            tables.setdefault(key, []).append(
                t.select(F.lit(outcome).alias("outcome"), F.lit(name).alias("learner"), "*"))

    roles = [(i, f, "continuous" if f in spec.continuous else "categorical",
              "centred and scaled" if f in spec.continuous else "one slot per training level")
             for i, f in enumerate(spec.features)]
    report = {
        "modelling_population": spark.createDataFrame(
            [(source_rows, min(sample_size or source_rows, source_rows), seed)],
            "source_rows long, modelled_rows long, random_seed int"),
        "feature_design": spark.createDataFrame(
            roles, "position int, feature string, role string, encoding string"),
        "held_out_ate": union([effects.observed_group_effect(
            matrices["test"], o, spec.treatment).select(F.lit(o).alias("outcome"), "*") for o in outcomes]),
        "methods": spark.createDataFrame(list(METHODS), "item string, description string"),
        "limitations": spark.createDataFrame([(t,) for t in LIMITATIONS], "limitation string"),
        "split_summary": split_summary,
        "design_matrix": design,
        "model_selection": learners.candidates_frame(spark, reports),
        **{k: union(v) for k, v in tables.items()},
        "chart_gain": charts.gain_lines(curves),
        "chart_policy": charts.policy_bars(policies),
    }
    # Every report table is small; compute the remaining ones, then release
    # the persisted splits, matrices and scored test rows.
    report = {k: small_table(v) for k, v in report.items()}
    for cached in matrices.values():
        cached.unpersist()
    for r in reports:
        r.release()
    report["runtime"] = spark.createDataFrame(
        [(time.perf_counter() - started,)], "planning_and_fit_seconds double")
    return report
