"""Chart-ready tables (the reference renders PNGs; here the tidy data).

Each function is a select/union over report tables, which are small.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlab.spec import BALANCE_THRESHOLD


def balance_bars(continuous: DataFrame, categorical: DataFrame,
                 threshold: float = BALANCE_THRESHOLD) -> DataFrame:
    """One bar per feature: absolute standardized difference and threshold."""
    return (continuous.select("feature", F.lit("continuous").alias("kind"),
                              F.col("absolute_standardized_mean_difference").alias("value"))
            .unionByName(categorical.select(
                "feature", F.lit("categorical").alias("kind"),
                F.col("maximum_absolute_standardized_difference").alias("value")))
            .withColumn("threshold", F.lit(threshold)))


def effect_points(effects: DataFrame) -> DataFrame:
    """Effect and 95% interval per outcome, in percentage points."""
    return effects.select(
        "outcome",
        (F.col("absolute_risk_difference") * 100).alias("effect_pp"),
        (F.col("absolute_risk_difference_ci_lower") * 100).alias("ci_lower_pp"),
        (F.col("absolute_risk_difference_ci_upper") * 100).alias("ci_upper_pp"))


def effect_vs_mde(effects: DataFrame, mde: DataFrame) -> DataFrame:
    """Observed effect beside the MDE at each power (pp)."""
    m = mde.groupBy("outcome").pivot("power", [0.8, 0.9]).agg(F.first("absolute_effect"))
    m = m.select("outcome", (F.col("`0.8`") * 100).alias("mde_80_pp"),
                 (F.col("`0.9`") * 100).alias("mde_90_pp"))
    return effect_points(effects).join(m, "outcome")


def gain_lines(curves: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """Policy, random and treat-all lines per (outcome, learner)."""
    out = None
    for (outcome, learner), c in curves.items():
        part = c.select(F.lit(outcome).alias("outcome"), F.lit(learner).alias("learner"),
                        "fraction", "policy_gain_per_100000", "random_gain_per_100000",
                        "treat_all_gain_per_100000")
        out = part if out is None else out.unionByName(part)
    return out


def policy_bars(policies: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """Policy vs random incremental outcomes per fraction and model."""
    out = None
    for (outcome, learner), p in policies.items():
        part = p.select(F.lit(outcome).alias("outcome"), F.lit(learner).alias("learner"),
                        "fraction", "incremental_outcomes_per_100000_population",
                        "random_targeting_per_100000_population",
                        "observed_difference_ci_lower", "observed_difference_ci_upper",
                        "insufficient_control_events")
        out = part if out is None else out.unionByName(part)
    return out
