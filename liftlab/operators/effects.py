"""Effect estimators over integer counts: E1, E4, E5, E10, E11.

All estimators are finalisers: column arithmetic over the (small) count
tables from :mod:`liftlab.operators.population`, one row per segment and
outcome. Normal tails use the SQL arithmetic of
:mod:`liftlab.functions.normal`, so no Python runs per row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlab.functions.normal import LOG_TINY, log_sf, ppf, sf
from liftlab.operators.population import _by, arm_counts, population_summary
from liftlab.spec import ExperimentSpec

INF = float("inf")


def _check_alpha(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must lie between 0 and 1, not {alpha}")
    return ppf(1.0 - alpha / 2.0)


def allocation_audit(df: DataFrame | None, spec: ExperimentSpec = ExperimentSpec(),
                     by: Sequence[str] = (), expected: float | None = None,
                     population: DataFrame | None = None) -> DataFrame:
    """Sample-ratio test of the treated share against the design share."""
    p = spec.expected_share if expected is None else expected
    if not 0 < p < 1:
        raise ValueError(f"the expected treated share must lie between 0 and 1, not {p}")
    by = _by(by)
    pop = population if population is not None else population_summary(df, spec, by)
    return allocation_from_counts(pop, p, by)


def allocation_from_counts(pop: DataFrame, p: float, by: Sequence[str] = ()) -> DataFrame:
    n, t = F.col("total_count"), F.col("treatment_count")
    observed = F.try_divide(t, n)
    expected_count = n * F.lit(p)
    z = F.try_divide(t - expected_count, F.sqrt(n * F.lit(p * (1 - p))))
    step = pop.select(
        *by,
        n.alias("total_observations"), t.alias("treatment_observations"),
        (n - t).alias("control_observations"),
        observed.alias("treatment_proportion"),
        (F.lit(1.0) - observed).alias("control_proportion"),
        F.lit(p).alias("expected_treatment_proportion"),
        (observed - F.lit(p)).alias("proportion_difference"),
        ((observed - F.lit(p)) * 100).alias("difference_percentage_points"),
        (t - expected_count).alias("count_difference_from_expected"),
        z.alias("z_statistic"),
        F.abs(z).alias("_absz"),
    )
    return step.withColumn("p_value", F.least(F.lit(1.0), F.lit(2.0) * sf("_absz"))).drop("_absz")


def effects_from_counts(counts: DataFrame, alpha: float = 0.05,
                        keep: Sequence[str] = ()) -> DataFrame:
    """E4 over a table with treatment/control counts and positives per row.

    Unpooled Wald interval for the risk difference (clipped to [-1, 1]),
    pooled two-proportion z test with log-scale p-values, and a log-scale
    Wald interval for the relative risk when both arms have events.
    """
    zc = _check_alpha(alpha)
    tp, tn = F.col("treatment_positive"), F.col("treatment_count")
    cp, cn = F.col("control_positive"), F.col("control_count")
    valid = (tn > 0) & (cn > 0)
    tr = F.when(valid, F.try_divide(tp, tn))
    cr = F.when(valid, F.try_divide(cp, cn))
    rd = tr - cr
    se = F.sqrt(F.try_divide(tr * (1 - tr), tn) + F.try_divide(cr * (1 - cr), cn))
    pooled = F.try_divide(tp + cp, tn + cn)
    null_se = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), tn)
                                               + F.try_divide(F.lit(1.0), cn)))
    z = (F.when(~valid, None)
         .when(null_se > 0, rd / null_se)
         .when(rd == 0, F.lit(0.0))
         .otherwise(F.lit(INF)))
    has_rr = valid & (tp > 0) & (cp > 0)
    rr = F.when(has_rr, tr / cr)
    one = F.lit(1.0)
    log_rr_se = F.sqrt(F.try_divide(one, tp) - F.try_divide(one, tn)
                       + F.try_divide(one, cp) - F.try_divide(one, cn))
    step = counts.select(
        *keep,
        tn.alias("treatment_count"), tp.alias("treatment_positive"), tr.alias("treatment_rate"),
        cn.alias("control_count"), cp.alias("control_positive"), cr.alias("control_rate"),
        F.lit(1.0 - alpha).alias("confidence_level"),
        rd.alias("absolute_risk_difference"),
        F.greatest(F.lit(-1.0), rd - zc * se).alias("absolute_risk_difference_ci_lower"),
        F.least(F.lit(1.0), rd + zc * se).alias("absolute_risk_difference_ci_upper"),
        se.alias("standard_error"),
        z.alias("z_statistic"),
        rr.alias("relative_risk"),
        F.when(has_rr, F.exp(F.log(rr) - zc * log_rr_se)).alias("relative_risk_ci_lower"),
        F.when(has_rr, F.exp(F.log(rr) + zc * log_rr_se)).alias("relative_risk_ci_upper"),
        (rr - 1).alias("relative_lift"),
        ((rr - 1) * 100).alias("relative_lift_percent"),
        (rd * 100000).alias("incremental_outcomes_per_100000_assigned"),
        F.abs(z).alias("_absz"),
    )
    log_p = F.least(F.lit(0.0), F.lit(math.log(2.0)) + log_sf("_absz"))
    step = step.withColumn("log_p_value", log_p).drop("_absz")
    return step.select(
        "*",
        F.when(F.col("log_p_value") > LOG_TINY, F.exp("log_p_value"))
         .when(F.col("log_p_value").isNotNull(), F.lit(0.0)).alias("p_value"),
        (F.col("log_p_value") / math.log(10.0)).alias("log10_p_value"),
    )


def itt_effects(df: DataFrame | None, spec: ExperimentSpec = ExperimentSpec(),
                by: Sequence[str] = (), alpha: float = 0.05,
                population: DataFrame | None = None) -> DataFrame:
    """Intention-to-treat effect of assignment on every outcome."""
    by = _by(by)
    pop = population if population is not None else population_summary(df, spec, by)
    counts = arm_counts(pop, spec.outcomes, by)
    return effects_from_counts(counts, alpha, keep=[*by, "outcome"])


# ---- Newcombe interval for held-out groups (E10) ---------------------------

def _wilson(x: Column, n: Column, z: float) -> tuple[Column, Column]:
    # Doubles: the product of two counts leaves bigint from about 6 billion rows an arm.
    x, n = x.cast("double"), n.cast("double")
    z2 = z * z
    centre = (x + z2 / 2.0) / (n + z2)
    half = F.lit(z) * F.sqrt(F.try_divide(x * (n - x), n) + z2 / 4.0) / (n + z2)
    return centre - half, centre + half


def newcombe_columns(tp: Column, tn: Column, cp: Column, cn: Column,
                     alpha: float = 0.05) -> dict[str, Column]:
    """Arm rates, difference and Newcombe hybrid-score interval (Wilson per arm).

    Null when an arm is empty (the estimator is undefined there).
    """
    z = _check_alpha(alpha)
    valid = (tn > 0) & (cn > 0)
    p1 = F.when(valid, F.try_divide(tp, tn))
    p0 = F.when(valid, F.try_divide(cp, cn))
    l1, u1 = _wilson(tp, tn, z)
    l0, u0 = _wilson(cp, cn, z)
    d = p1 - p0
    return {
        "treatment_count": tn, "control_count": cn,
        "treatment_positive": tp, "control_positive": cp,
        "treatment_rate": p1, "control_rate": p0,
        "observed_difference": d,
        "observed_difference_ci_lower": d - F.sqrt((p1 - l1) ** 2 + (u0 - p0) ** 2),
        "observed_difference_ci_upper": d + F.sqrt((u1 - p1) ** 2 + (p0 - l0) ** 2),
        "confidence_level": F.lit(1.0 - alpha),
    }


def observed_group_effect(df: DataFrame, outcome: str, treatment: str = "treatment",
                          by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Treated-minus-control rate with a Newcombe interval, per group."""
    by = _by(by)
    t, y = F.col(treatment), F.col(outcome)
    agg = df.groupBy(*by).agg(
        F.count_if(t == 1).alias("tn"), F.count_if(t == 0).alias("cn"),
        F.count_if((t == 1) & (y == 1)).alias("tp"),
        F.count_if((t == 0) & (y == 1)).alias("cp"))
    cols = newcombe_columns(F.col("tp"), F.col("tn"), F.col("cp"), F.col("cn"), alpha)
    return agg.select(*by, *[c.alias(k) for k, c in cols.items()])


# ---- IPW transformed outcome (E11) -----------------------------------------

def transformed_outcome_col(outcome: Column, treatment: Column, propensity: float) -> Column:
    """Z = Y*T/p - Y*(1-T)/(1-p)."""
    if not 0 < propensity < 1:
        raise ValueError(f"propensity must lie between 0 and 1, not {propensity}")
    return (outcome * treatment / F.lit(propensity)
            - outcome * (F.lit(1) - treatment) / F.lit(1.0 - propensity))


def transformed_outcome(df: DataFrame, outcome: str, spec: ExperimentSpec = ExperimentSpec(),
                        propensity: float | None = None, name: str = "transformed_outcome"
                        ) -> DataFrame:
    """Append Z. Treatment outside {0, 1} fails the task (``raise_error``)."""
    p = spec.propensity if propensity is None else propensity
    t = F.col(spec.treatment)
    checked_t = F.when(t.isin(0, 1), t).otherwise(
        F.raise_error(F.lit("assignment must be 0 or 1")))
    return df.withColumn(name, transformed_outcome_col(F.col(outcome), checked_t, p))


def transformed_outcome_summary(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(),
                                by: Sequence[str] = (), propensity: float | None = None
                                ) -> DataFrame:
    """Mean Z per outcome (the IPW effect estimate), from exact integer counts."""
    p = spec.propensity if propensity is None else propensity
    by = _by(by)
    counts = arm_counts(population_summary(df, spec, by), spec.outcomes, by)
    total_z = F.col("treatment_positive") / F.lit(p) - F.col("control_positive") / F.lit(1.0 - p)
    return counts.select(
        *by, "outcome", F.col("total_count").alias("observations"),
        "treatment_positive", "control_positive",
        F.lit(p).alias("propensity"),
        F.try_divide(total_z, F.col("total_count")).alias("mean_transformed_outcome"),
    )
