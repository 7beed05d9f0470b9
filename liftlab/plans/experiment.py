"""C4: the experiment report as a set of DataFrames.

Jobs over unit rows: one population aggregate (reused by every finaliser),
one continuous-balance aggregate, one categorical level-count aggregate and
the predictability diagnostic. Everything else is arithmetic over those
small tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlab.operators import balance, effects, learners, population, power
from liftlab.plans import charts
from liftlab.session import small_table
from liftlab.sources.ingest import with_row_id
from liftlab.spec import BALANCE_THRESHOLD, ExperimentSpec

#: What each table rests on, for readers of the report.
METHODS = (
    ("allocation", "normal score test of the treated share against the design share, two-sided"),
    ("risk difference", "difference of rates with a Wald interval that does not pool the arms"),
    ("test of no effect", "z test of two proportions with the pooled rate, two-sided"),
    ("relative risk", "ratio of rates with a Wald interval on the log scale"),
    ("detectable effect", "normal power of Cohen's h, solved at the observed arm sizes"),
    ("categorical balance", "standardized difference per level; per feature the largest one and "
                            "the root mean square weighted by level share"),
)
LIMITATIONS = (
    "The effects hold for the units analysed; costs and returns are not part of them.",
    "Rows that are equal in every column are kept: equality does not show a repeated unit.",
    "Exposure happens after assignment, so it is described and never taken as the cause.",
    "Rows count as independent units: the table names no clusters.",
)


def analyze_experiment(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(), *,
                       by: Sequence[str] = (), alpha: float = 0.05,
                       predictability_sample_size: float | None = learners.ALL_ROWS,
                       seed: int = 42) -> dict[str, DataFrame]:
    """Randomisation audit, balance, ITT effects, sensitivity and exposure.

    Without segments every table with a fixed number of rows is a local relation: population and
    balance are computed once, and what derives from them needs no further job. ``categorical_levels`` has a row per level and stays
    distributed, as do all tables with ``by``; they rest on the cached aggregates
    ``population``, ``continuous_balance`` and ``categorical_levels``:
    ``unpersist()`` those when the report is no longer needed.

    The predictability diagnostic fits on every training row, or on at most
    ``predictability_sample_size`` of them; None leaves it out.
    """
    spec.require_columns(df)
    df = with_row_id(df, spec.id)
    spark = df.sparkSession
    by = list(by)
    # The predictability diagnostic fits a model (eager jobs); it runs in a
    # driver thread while this thread computes the aggregate tables.
    pool = ThreadPoolExecutor(max_workers=1) if predictability_sample_size else None
    pending = pool.submit(lambda: small_table(learners.treatment_predictability(
        df, spec, sample_size=predictability_sample_size, seed=seed))) if pool else None
    settled = (lambda t: t.cache()) if by else small_table  # per segment, tables may be large
    pop = settled(population.population_summary(df, spec, by))
    cont = settled(balance.continuous_balance(df, spec, by))
    levels = balance.categorical_level_balance(df, spec, by).cache()
    cat = balance.categorical_balance(None, spec, by, levels=levels)
    if not by:
        cat = small_table(cat)
    itt = effects.itt_effects(None, spec, by, alpha, population=pop)
    mde = power.mde_grid(None, spec, by, alpha=alpha, population=pop)
    report = {
        "population": pop,
        "analysis_population": pop.select(
            *by, F.col("total_count").alias("observations"),
            F.lit(len(spec.features)).alias("features"), F.lit(len(spec.continuous)).alias("continuous_features"),
            F.lit(len(spec.categorical)).alias("categorical_features"),
            F.lit(", ".join(spec.outcomes)).alias("outcomes"), F.lit(alpha).alias("alpha")),
        "allocation": effects.allocation_audit(None, spec, by, population=pop),
        "continuous_balance": cont,
        "categorical_levels": levels,
        "categorical_balance": cat,
        "balance_summary": balance.balance_summary(df, spec, by, BALANCE_THRESHOLD, cont, cat),
        "outcome_descriptives": population.outcome_descriptives(None, spec, by, population=pop),
        "itt_effects": itt,
        "mde": mde,
        "exposure_diagnostics": population.exposure_diagnostics(None, spec, by, population=pop),
        "methods": spark.createDataFrame(list(METHODS), "item string, description string"),
        "limitations": spark.createDataFrame([(t,) for t in LIMITATIONS], "limitation string"),
    }
    if not by:
        report["chart_balance"] = charts.balance_bars(cont, cat)
        report["chart_effects"] = charts.effect_points(itt)
        report["chart_sensitivity"] = charts.effect_vs_mde(itt, mde)
        report = {k: v if k == "categorical_levels" else small_table(v) for k, v in report.items()}
    if pending is not None:
        report["treatment_predictability"] = pending.result()
        pool.shutdown()
    return report
