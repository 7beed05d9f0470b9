"""Population counts (A6) and the descriptive tables built on them.

The whole experiment reduces to integer counts per segment: one hash
aggregate with partial (map-side) aggregation, so the shuffle carries one
small row per map task and segment regardless of table size or skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlab.spec import ExperimentSpec


def _by(by: Sequence[str] | str | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def population_summary(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(),
                       by: Sequence[str] = ()) -> DataFrame:
    """One row per segment: unit counts by arm and positives of every binary.

    Duplicate rows are units and are all counted. A null or non-binary
    assignment is an error; see :func:`invalid_assignment`. Null outcomes are
    not positives.
    """
    by = _by(by)
    t = F.col(spec.treatment)
    tracked = [*spec.outcomes, *([spec.exposure] if spec.exposure else [])]
    spec.require_columns(df, [*by, spec.treatment, *tracked])
    aggs: list[Column] = [F.count(F.lit(1)).alias("total_count"),
                          F.count_if(t == 1).alias("treatment_count"),
                          F.count_if(not_binary(t)).alias("_invalid")]
    for name in tracked:
        y = F.col(name)
        aggs += [F.count_if(y == 1).alias(f"{name}_total"),
                 F.count_if((y == 1) & (t == 1)).alias(f"{name}_treatment"),
                 F.count_if((y == 1) & (t == 0)).alias(f"{name}_control")]
    out = df.groupBy(*by).agg(*aggs)
    # Checked on the aggregate: one comparison per segment, in the same job.
    total = F.when(F.col("_invalid") == 0, F.col("total_count")).otherwise(F.raise_error(F.concat(
        F.col("_invalid").cast("string"),
        F.lit(f" rows have a null or non-binary {spec.treatment}; assignment must be 0 or 1"))))
    out = out.withColumn("total_count", total.cast("bigint"))
    return out.select(*by, "total_count", *[c for c in out.columns if c not in (
        *by, "total_count", "_invalid")],
        (F.col("total_count") - F.col("treatment_count")).alias("control_count"))


def not_binary(c: Column) -> Column:
    """True for null and for values other than 0 and 1."""
    return ~F.coalesce(c.isin(0, 1), F.lit(False))


def invalid_assignment(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(),
                       by: Sequence[str] = ()) -> DataFrame:
    """Rows per segment whose assignment or outcomes are null or not 0 or 1.

    Estimators refuse such assignments; this table says where they are.
    """
    by = _by(by)
    names = [spec.treatment, *spec.outcomes]
    spec.require_columns(df, [*by, *names])
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(n).isNull()).alias(f"{n}_missing") for n in names],
        *[F.count_if(F.col(n).isNotNull() & not_binary(F.col(n))).alias(f"{n}_invalid") for n in names])


def arm_counts(population: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Reshape a population summary to one row per (segment, outcome).

    Runs on the small aggregate, never on unit rows.
    """
    by = _by(by)
    pieces = ", ".join(
        f"'{n}', `{n}_total`, `{n}_treatment`, `{n}_control`" for n in names)
    stacked = F.expr(
        f"stack({len(names)}, {pieces}) AS (outcome, total_positive, treatment_positive, "
        f"control_positive)")
    return population.select(*by, "total_count", "treatment_count", "control_count", stacked)


def outcome_descriptives(df: DataFrame | None, spec: ExperimentSpec = ExperimentSpec(),
                         by: Sequence[str] = (), population: DataFrame | None = None
                         ) -> DataFrame:
    """Overall / treated / control counts, positives and rates per outcome."""
    by = _by(by)
    pop = population if population is not None else population_summary(df, spec, by)
    counts = arm_counts(pop, spec.outcomes, by)
    return counts.select(
        *by, "outcome",
        F.col("total_count").alias("overall_count"),
        F.col("total_positive").alias("overall_positive"),
        F.try_divide("total_positive", "total_count").alias("overall_rate"),
        "treatment_count", "treatment_positive",
        F.try_divide("treatment_positive", "treatment_count").alias("treatment_rate"),
        "control_count", "control_positive",
        F.try_divide("control_positive", "control_count").alias("control_rate"),
    )


def exposure_diagnostics(df: DataFrame | None, spec: ExperimentSpec = ExperimentSpec(),
                         by: Sequence[str] = (), population: DataFrame | None = None
                         ) -> DataFrame:
    """Exposure rate per arm. Exposure follows assignment; descriptive only."""
    if not spec.exposure:
        raise ValueError("spec has no exposure column")
    by = _by(by)
    pop = population if population is not None else population_summary(df, spec, by)
    e = spec.exposure
    return pop.select(
        *by,
        F.col(f"{e}_treatment").alias("treated_positive"),
        F.col("treatment_count").alias("treated_count"),
        F.try_divide(f"{e}_treatment", "treatment_count").alias("treated_exposure_rate"),
        F.col(f"{e}_control").alias("control_positive"),
        "control_count",
        F.try_divide(f"{e}_control", "control_count").alias("control_exposure_rate"),
        (F.col(f"{e}_control") == 0).alias("control_has_no_exposure"),
        F.lit(True).alias("post_assignment_variable"),
        F.lit(False).alias("causal_effect_estimated"),
    )
