"""Covariate balance between arms: A7, A8, A12, E2, E3.

Continuous features: one wide aggregate (mean and sample sd per arm for
every feature) in a single scan, reshaped afterwards on the one-row result.
Categorical features: one scan that unpivots every categorical feature to
(feature, level) and counts per arm; the per-level and per-feature
statistics then run on the small level table. The reference rescans the
table once per categorical feature; here it is one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlab.operators.population import _by
from liftlab.spec import BALANCE_THRESHOLD, ExperimentSpec

INF = float("inf")


def smd_column(m1, m0, s1, s0):
    """(m1 - m0) / sqrt((s1^2 + s0^2) / 2); 0 or +inf when the pooled sd is 0."""
    pooled = F.sqrt((s1 * s1 + s0 * s0) / 2.0)
    return (F.when(pooled > 0, (m1 - m0) / pooled)
            .when(m1 == m0, F.lit(0.0))
            .when(pooled.isNotNull(), F.lit(INF)))


def continuous_balance(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(),
                       by: Sequence[str] = ()) -> DataFrame:
    """A7 + E2: one row per (segment, continuous feature)."""
    by = _by(by)
    spec.require_columns(df, [*by, spec.treatment, *spec.continuous])
    t = F.col(spec.treatment)
    aggs = []
    for i, f in enumerate(spec.continuous):
        x = F.col(f).cast("double")
        aggs += [F.avg(F.when(t == 1, x)).alias(f"m1_{i}"),
                 F.avg(F.when(t == 0, x)).alias(f"m0_{i}"),
                 F.stddev_samp(F.when(t == 1, x)).alias(f"s1_{i}"),
                 F.stddev_samp(F.when(t == 0, x)).alias(f"s0_{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    pieces = ", ".join(f"'{f}', m1_{i}, m0_{i}, s1_{i}, s0_{i}"
                       for i, f in enumerate(spec.continuous))
    long = wide.select(*by, F.expr(
        f"stack({len(spec.continuous)}, {pieces}) AS (feature, treatment_mean, control_mean, "
        f"treatment_standard_deviation, control_standard_deviation)"))
    smd = smd_column(F.col("treatment_mean"), F.col("control_mean"),
                     F.col("treatment_standard_deviation"), F.col("control_standard_deviation"))
    s1, s0 = F.col("treatment_standard_deviation"), F.col("control_standard_deviation")
    return long.select(
        "*", smd.alias("standardized_mean_difference"),
        F.abs(smd).alias("absolute_standardized_mean_difference"),
        F.try_divide(s1 * s1, s0 * s0).alias("variance_ratio"))


def categorical_level_counts(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(),
                             by: Sequence[str] = ()) -> DataFrame:
    """Counts per (segment, feature, level, arm) in one pass.

    Levels are compared as strings (numeric codes are nominal); null is a
    level of its own.
    """
    by = _by(by)
    spec.require_columns(df, [*by, spec.treatment, *spec.categorical])
    t = F.col(spec.treatment)
    # ``inline`` and not ``unpivot``: shuffles above an Expand are not reused.
    long = df.select(*by, t.alias("_t"), F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in spec.categorical])))
    return long.groupBy(*by, "feature", "level").agg(
        F.count_if(F.col("_t") == 1).alias("treatment_count"),
        F.count_if(F.col("_t") == 0).alias("control_count"))


def categorical_level_balance(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(),
                              by: Sequence[str] = ()) -> DataFrame:
    """E3 per level: indicator proportions per arm and their SMD (0 when sd is 0)."""
    by = _by(by)
    counts = categorical_level_counts(df, spec, by)
    # Every row counts once in each feature, null being a level: a feature's arm totals are the
    # sums of its level counts. Both tables read the same shuffle (a reused exchange), so the
    # table is scanned once, and no window gathers all levels of a feature in one task.
    totals = counts.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("feature").alias("_feature")).agg(
        F.sum("treatment_count").alias("_n1"), F.sum("control_count").alias("_n0"))
    same = F.col("feature") == F.col("_feature")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    # Without segments the totals have a row per feature.
    step = counts.join(totals if by else F.broadcast(totals), same)
    p1 = F.try_divide(F.col("treatment_count"), F.col("_n1"))
    p0 = F.try_divide(F.col("control_count"), F.col("_n0"))
    pooled = F.sqrt((p1 * (1 - p1) + p0 * (1 - p0)) / 2.0)
    smd = F.when(pooled > 0, (p1 - p0) / pooled).when(pooled.isNotNull(), F.lit(0.0))
    weight = F.try_divide(F.col("treatment_count") + F.col("control_count"),
                          F.col("_n1") + F.col("_n0"))
    return step.select(
        *by, "feature", "level", "treatment_count", "control_count",
        p1.alias("treatment_proportion"), p0.alias("control_proportion"),
        smd.alias("standardized_difference"), weight.alias("pooled_weight"))


def categorical_balance(df: DataFrame | None, spec: ExperimentSpec = ExperimentSpec(),
                        by: Sequence[str] = (), levels: DataFrame | None = None) -> DataFrame:
    """E3 per feature: level count, max |SMD| (ties: smallest level), weighted RMS.

    ``levels``: the level table, if it is there already.
    """
    by = _by(by)
    levels = levels if levels is not None else categorical_level_balance(df, spec, by)
    levels = levels.withColumn("_abs", F.abs("standardized_difference"))
    key = F.struct(-F.col("_abs"), F.col("level"))
    return levels.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("level_count"),
        F.max("_abs").alias("maximum_absolute_standardized_difference"),
        F.sqrt(F.sum(F.col("pooled_weight") * F.col("standardized_difference") ** 2)
               ).alias("weighted_rms_standardized_difference"),
        F.min_by("level", key).alias("maximum_difference_level"),
        F.min_by("treatment_proportion", key).alias("maximum_level_treatment_proportion"),
        F.min_by("control_proportion", key).alias("maximum_level_control_proportion"),
        F.min_by("standardized_difference", key).alias("maximum_level_standardized_difference"),
    )


def balance_summary(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(),
                    by: Sequence[str] = (), threshold: float = BALANCE_THRESHOLD,
                    continuous: DataFrame | None = None, categorical: DataFrame | None = None
                    ) -> DataFrame:
    """Largest absolute standardized difference and the threshold flag."""
    by = _by(by)
    cont = continuous if continuous is not None else continuous_balance(df, spec, by)
    cat = categorical if categorical is not None else categorical_balance(df, spec, by)
    both = (cont.select(*by, F.lit("continuous").alias("kind"),
                        F.col("absolute_standardized_mean_difference").alias("v"))
            .unionByName(cat.select(*by, F.lit("categorical").alias("kind"),
                                    F.col("maximum_absolute_standardized_difference").alias("v"))))
    out = both.groupBy(*by).agg(
        F.max(F.when(F.col("kind") == "continuous", F.col("v"))).alias(
            "maximum_continuous_standardized_difference"),
        F.max(F.when(F.col("kind") == "categorical", F.col("v"))).alias(
            "maximum_categorical_standardized_difference"),
        F.max("v").alias("maximum_absolute_standardized_difference"))
    return out.withColumn("all_features_below_threshold",
                          F.col("maximum_absolute_standardized_difference") < threshold
                          ).withColumn("threshold", F.lit(threshold))
