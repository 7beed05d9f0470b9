"""Sensitivity: minimum detectable effect (E6) and required sample size.

Both solve the two-sided two-sample normal power equation for Cohen's h.
The equation depends on the data only through the noncentrality
``d = h / sqrt(1/n1 + 1/n0)``; the root ``d*(power, alpha)`` is a function
of the parameters alone, solved once on the driver
(:func:`liftlab.functions.normal.detectable_shift`). The per-segment work
is then plain column arithmetic over the population counts, one row per
segment x outcome x grid point, with the grid expanded by ``explode`` of a
literal array (no join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlab.functions.normal import detectable_shift
from liftlab.operators.population import _by, arm_counts, population_summary
from liftlab.spec import ExperimentSpec

POWERS = (0.80, 0.90)
TARGET_EFFECTS = (0.001, 0.002, 0.005, 0.01)
TREATMENT_SHARES = (0.5, 0.85)


def _grid(items: Sequence[dict]) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in it.items()])
                               for it in items]))


def mde_grid(df: DataFrame | None, spec: ExperimentSpec = ExperimentSpec(),
             by: Sequence[str] = (), powers: Sequence[float] = POWERS, alpha: float = 0.05,
             population: DataFrame | None = None) -> DataFrame:
    """Absolute / relative MDE for the observed control rate and arm sizes.

    Null when the control rate is 0 or 1 or an arm is empty (the reference
    raises there; per segment a null with the inputs is more useful).
    """
    by = _by(by)
    pop = population if population is not None else population_summary(df, spec, by)
    counts = arm_counts(pop, spec.outcomes, by)
    grid = _grid([{"power": float(p), "alpha": float(alpha),
                   "_d": detectable_shift(float(p), float(alpha))} for p in powers])
    step = counts.select(*by, "outcome", "treatment_count", "control_count",
                         F.try_divide("control_positive", "control_count").alias("b"),
                         grid.alias("_g")).select("*", "_g.*").drop("_g")
    b, n1, n0 = F.col("b"), F.col("treatment_count"), F.col("control_count")
    ok = (b > 0) & (b < 1) & (n1 > 0) & (n0 > 0)
    h = F.col("_d") * F.sqrt(F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0))
    detectable = F.pow(F.sin((F.lit(2.0) * F.asin(F.sqrt(b)) + F.abs(h)) / 2.0), 2)
    absolute = F.when(ok, detectable - b)
    return step.select(
        *by, "outcome", "power", "alpha", b.alias("baseline_control_rate"),
        n1.alias("treatment_count"), n0.alias("control_count"),
        absolute.alias("absolute_effect"),
        F.try_divide(absolute, b).alias("relative_effect"),
        (F.try_divide(absolute, b) * 100).alias("relative_effect_percent"))


def sample_size_grid(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(),
                     by: Sequence[str] = (), targets: Sequence[float] = TARGET_EFFECTS,
                     shares: Sequence[float] = TREATMENT_SHARES,
                     powers: Sequence[float] = POWERS, alpha: float = 0.05) -> DataFrame:
    """Total units needed to detect each absolute effect from the observed
    control rate, for each treatment share and power: ``ceil(n0 (1 + ratio))``."""
    by = _by(by)
    for s in shares:
        if not 0 < s < 1:
            raise ValueError("a treated share lies between 0 and 1")
    counts = arm_counts(population_summary(df, spec, by), spec.outcomes, by)
    grid = _grid([{"target_absolute_effect": float(e), "treatment_share": float(s),
                   "power": float(p), "alpha": float(alpha),
                   "_d": detectable_shift(float(p), float(alpha))}
                  for e in targets for s in shares for p in powers])
    step = counts.select(*by, "outcome",
                         F.try_divide("control_positive", "control_count").alias("b"),
                         grid.alias("_g")).select("*", "_g.*").drop("_g")
    b = F.col("b")
    target = b + F.col("target_absolute_effect")
    ok = (b > 0) & (b < 1) & (target > 0) & (target < 1)
    h = F.abs(F.lit(2.0) * F.asin(F.sqrt(target)) - F.lit(2.0) * F.asin(F.sqrt(b)))
    ratio = F.col("treatment_share") / (F.lit(1.0) - F.col("treatment_share"))
    n_eff = F.pow(F.try_divide(F.col("_d"), h), 2)
    control = n_eff * (F.lit(1.0) + ratio) / ratio
    total = F.when(ok & (h > 0), F.ceil(control * (F.lit(1.0) + ratio)).cast("bigint"))
    return step.select(
        *by, "outcome", "target_absolute_effect", "treatment_share", "power", "alpha",
        b.alias("baseline_control_rate"), total.alias("required_total_sample_size"))
