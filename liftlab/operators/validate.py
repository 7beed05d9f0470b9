"""Table validation and profiles: V4-V8, A1-A5, C1, C2.

Every profile is a single wide aggregate over the table (one scan, partial
aggregation on the executors), reshaped to one row per column afterwards on
the small result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftlab.spec import ExperimentSpec, ValidationError

INF = float("inf")
#: Bad values listed per column.
BAD_VALUES = 10


def _is_float(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def _finite(c: Column, dt: T.DataType) -> Column:
    if _is_float(dt):
        return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INF)), c)
    return c


def column_profile_aggs(df: DataFrame, columns: Sequence[str] | None = None
                        ) -> tuple[list[Column], list[str]]:
    """Named aggregates behind :func:`column_profile` (usable in ``observe``)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = list(columns) if columns is not None else [
        n for n, dt in fields.items() if isinstance(dt, T.NumericType)]
    aggs = []
    for i, n in enumerate(names):
        dt = fields[n]
        c = F.col(n)
        x = _finite(c, dt).cast("double")
        nonfinite = (F.count_if(F.isnan(c) | (F.abs(c) == F.lit(INF))) if _is_float(dt)
                     else F.lit(0).cast("bigint"))
        aggs += [F.count_if(c.isNull()).alias(f"miss_{i}"), nonfinite.alias(f"nf_{i}"),
                 F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}"),
                 F.avg(x).alias(f"mean_{i}"), F.stddev_pop(x).alias(f"sd_{i}")]
    return aggs, names


def column_profile_from(wide: DataFrame, names: Sequence[str], dtypes: dict[str, str]
                        ) -> DataFrame:
    """Reshape the one-row aggregate to one row per column."""
    pieces = ", ".join(
        f"'{n}', '{dtypes[n]}', miss_{i}, nf_{i}, min_{i}, max_{i}, mean_{i}, sd_{i}"
        for i, n in enumerate(names))
    return wide.select(F.expr(
        f"stack({len(names)}, {pieces}) AS (column_name, dtype, missing_count, nonfinite_count, "
        f"minimum, maximum, mean, standard_deviation)"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A1 + V6: per numeric column, missing and non-finite counts, and min,
    max, mean and population sd over the finite values (null when none)."""
    aggs, names = column_profile_aggs(df, columns)
    dtypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return column_profile_from(df.agg(*aggs), names, dtypes)


def binary_profile_aggs(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(),
                        columns: Sequence[str] | None = None) -> tuple[list[Column], list[str]]:
    names = list(columns) if columns is not None else list(spec.binaries)
    spec.require_columns(df, names)
    aggs = []
    for i, n in enumerate(names):
        c = F.col(n).cast("double")
        bad = c.isNotNull() & ~c.isin(0.0, 1.0)
        aggs += [F.count_if(c.isNull()).alias(f"bmiss_{i}"),
                 F.count_if(c == 0.0).alias(f"zero_{i}"), F.count_if(c == 1.0).alias(f"one_{i}"),
                 F.count_if(bad).alias(f"bad_{i}"),
                 F.min(F.when(bad, c)).alias(f"badmin_{i}"),
                 F.max(F.when(bad, c)).alias(f"badmax_{i}")]
    return aggs, names


def binary_profile_from(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    pieces = ", ".join(f"'{n}', bmiss_{i}, zero_{i}, one_{i}, bad_{i}, badmin_{i}, badmax_{i}"
                       for i, n in enumerate(names))
    long = wide.select(F.expr(
        f"stack({len(names)}, {pieces}) AS (column_name, missing_count, count_0, count_1, "
        f"invalid_count, invalid_minimum, invalid_maximum)"))
    valid_n = F.col("count_0") + F.col("count_1")
    return long.select(
        "*",
        F.try_divide(F.col("count_0"), valid_n).alias("proportion_0"),
        F.try_divide(F.col("count_1"), valid_n).alias("proportion_1"),
        (F.col("invalid_count") == 0).alias("valid"))


def binary_profile(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(),
                   columns: Sequence[str] | None = None) -> DataFrame:
    """A2 + V4: counts of 0 and 1, missing, and values outside {0, 1}.

    0.0 and 1.0 are valid; null is missing, not invalid. Invalid values are
    summarised by count, min and max (never collected as a set).
    """
    aggs, names = binary_profile_aggs(df, spec, columns)
    return binary_profile_from(df.agg(*aggs), names)


def top_values(df: DataFrame, values: Mapping[str, Column], k: int) -> DataFrame:
    """The ``k`` most frequent non-null values per name: (column_name, value, rows, rank), exact.

    Ties go to the smaller value. Values are counted with map-side combine, and each task
    keeps its ``k`` best per name before the ranking shuffle (a window group limit).
    """
    one = [F.when(v.isNotNull(), F.struct(F.lit(n).alias("column_name"), v.alias("value"))) for n, v in values.items()]
    counts = df.select(F.inline(F.array_compact(F.array(*one)))).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("rows"))
    best = Window.partitionBy("column_name").orderBy(F.desc("rows"), "value")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def invalid_values(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(),
                   columns: Sequence[str] | None = None, k: int = BAD_VALUES) -> DataFrame:
    """V4: the most frequent values outside {0, 1} of every binary column, with their rows."""
    names = list(columns) if columns is not None else list(spec.binaries)
    spec.require_columns(df, names)
    number = {n: F.col(f"`{n}`").cast("double") for n in names}
    return top_values(df, {n: F.when(~c.isin(0.0, 1.0), c) for n, c in number.items()}, k)


def listed(values: DataFrame) -> str:
    """Bad values as text, for messages: at most ``k`` per column."""
    by: dict[str, list[str]] = {}
    for r in values.orderBy("column_name", "rank").collect():
        by.setdefault(r["column_name"], []).append(f"{r['value']} in {r['rows']} rows")
    return "; ".join(f"{n}: {', '.join(v)}" for n, v in by.items())


def assert_binary(profile: DataFrame, df: DataFrame | None = None,
                  spec: ExperimentSpec = ExperimentSpec()) -> None:
    """Fail when any binary column holds a value outside {0, 1} (V4), naming the columns
    and, if the table is given, their most frequent bad values."""
    bad = profile.where(F.col("invalid_count") > 0).select(
        "column_name", "invalid_count", "invalid_minimum", "invalid_maximum").collect()
    if bad:
        found = "; ".join(f"{r.column_name} ({r.invalid_count} values from {r.invalid_minimum} to "
                          f"{r.invalid_maximum})" for r in bad)
        if df is not None:
            found += ". Most frequent: " + listed(invalid_values(df, spec, [r.column_name for r in bad]))
        raise ValidationError(f"Values other than 0 and 1 in binary columns: {found}")


def default_rules(spec: ExperimentSpec = ExperimentSpec()) -> dict[str, Column]:
    rules: dict[str, Column] = {}
    if "conversion" in spec.outcomes and "visit" in spec.outcomes:
        rules["conversion_without_visit"] = (F.col("conversion") == 1) & (F.col("visit") != 1)
    if spec.exposure:
        rules["exposure_without_treatment"] = ((F.col(spec.exposure) == 1)
                                               & (F.col(spec.treatment) != 1))
    return rules


def logical_violations(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(),
                       rules: Mapping[str, Column] | None = None) -> DataFrame:
    """V5: rows breaking each logical rule; reported, never fatal.

    A rule that evaluates to null (a null on either side) is not a violation.
    """
    rules = dict(rules) if rules is not None else default_rules(spec)
    wide = df.agg(*[F.count_if(cond).alias(f"r{i}") for i, cond in enumerate(rules.values())])
    pieces = ", ".join(f"'{name}', r{i}" for i, name in enumerate(rules))
    return wide.select(F.expr(f"stack({len(rules)}, {pieces}) AS (rule, violation_count)"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """A4: rows minus distinct rows. Duplicates are reported, never removed.

    Rows are first grouped by a narrow 64-bit hash. Only rows whose hash is
    seen more than once are then compared in full, so the wide shuffle holds
    the real candidates alone. Both groupings combine on the map side, so a
    hot duplicate collapses to one row per task.
    """
    h = F.xxhash64(*[_canonical(F.col(f.name), f.dataType) for f in df.schema.fields])
    keyed = df.withColumn("_h", h)
    hashes = keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    many = hashes.where("_n > 1").select("_h")
    groups = keyed.join(many, "_h", "left_semi").groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    single = hashes.agg(F.sum("_n").alias("row_count"), F.count_if(F.col("_n") == 1).alias("alone"))
    return single.crossJoin(groups.agg(F.count(F.lit(1)).alias("groups"))).select(
        F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"),
        (F.col("alone") + F.col("groups")).alias("distinct_rows"),
        (F.coalesce("row_count", F.lit(0)) - F.col("alone") - F.col("groups")).cast("bigint").alias(
            "duplicate_full_rows"))


def _canonical(c: Column, kind: T.DataType) -> Column:
    """Equal values with equal hashes: null apart from zero, -0.0 as 0.0."""
    value = F.when(c == 0, F.lit(0.0)).otherwise(c) if _is_float(kind) else c
    return F.struct(c.isNull(), value)


def feature_cardinality(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(),
                        exact: bool = True, rsd: float = 0.05) -> DataFrame:
    """A3: distinct non-null values per feature (exact, or HyperLogLog++ sketch)."""
    feats = list(spec.features)
    if exact:
        aggs = [F.count_distinct(F.col(f)).alias(f"c{i}") for i, f in enumerate(feats)]
    else:
        aggs = [F.approx_count_distinct(F.col(f), rsd).alias(f"c{i}") for i, f in enumerate(feats)]
    wide = df.agg(*aggs)
    pieces = ", ".join(f"'{f}', c{i}" for i, f in enumerate(feats))
    return wide.select(F.expr(f"stack({len(feats)}, {pieces}) AS (feature, cardinality)"))


def narrow_binaries(df: DataFrame, spec: ExperimentSpec = ExperimentSpec()) -> DataFrame:
    """V8: store binaries as 8-bit integers. Run V4 first: a cast of 0.5 is silent."""
    return df.select(*[F.col(c).cast("byte").alias(c) if c in spec.binaries else F.col(c)
                       for c in df.columns])


def statistics_match(left: str, right: str, rel: float = 1e-10, abs_tol: float = 1e-12) -> Column:
    """Both null, or math.isclose(rel 1e-10, abs 1e-12)."""
    a, b = F.col(left), F.col(right)
    close = F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol))
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(close)


def table_summary(df: DataFrame, spec: ExperimentSpec = ExperimentSpec()) -> dict[str, DataFrame]:
    """A5: row count, schema, column and binary profiles and violations, in one job.

    The job is one wide aggregate; the tables are cut from its single row.
    """
    rules = default_rules(spec)
    col_aggs, col_names = column_profile_aggs(df)
    bin_aggs, bin_names = binary_profile_aggs(df, spec)
    wide = df.agg(F.count(F.lit(1)).alias("row_count"), *col_aggs, *bin_aggs,
                  *[F.count_if(c).alias(f"rule_{i}") for i, c in enumerate(rules.values())])
    wide = df.sparkSession.createDataFrame(wide.collect(), wide.schema)  # one row
    dtypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pieces = ", ".join(f"'{name}', rule_{i}" for i, name in enumerate(rules))
    schema = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)],
        "position int, column_name string, dtype string, nullable boolean")
    out = {"table": wide.select("row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count")),
           "schema": schema, "columns": column_profile_from(wide, col_names, dtypes),
           "binaries": binary_profile_from(wide, bin_names)}
    if rules:
        out["violations"] = wide.select(F.expr(f"stack({len(rules)}, {pieces}) AS (rule, violation_count)"))
    return out


def profile_comparison(left: DataFrame, right: DataFrame,
                       spec: ExperimentSpec = ExperimentSpec(), *,
                       profiles: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Per column: both profiles side by side and whether they agree."""
    lprof, rprof = profiles or (column_profile(left), column_profile(right))
    # One row per column: a single partition each, so the join needs no shuffle.
    lp, rp = lprof.coalesce(1).alias("l"), rprof.coalesce(1).alias("r")
    joined = lp.join(rp, F.col("l.column_name") == F.col("r.column_name"), "full_outer")
    cols = [F.coalesce(F.col("l.column_name"), F.col("r.column_name")).alias("column_name"),
            F.col("l.column_name").isNotNull().alias("in_left"),
            F.col("r.column_name").isNotNull().alias("in_right"),
            F.col("l.missing_count").alias("left_missing"),
            F.col("r.missing_count").alias("right_missing")]
    for s in ("minimum", "maximum", "mean", "standard_deviation"):
        cols += [F.col(f"l.{s}").alias(f"left_{s}"), F.col(f"r.{s}").alias(f"right_{s}")]
    out = joined.select(*cols)
    stats_ok = None
    for s in ("minimum", "maximum", "mean", "standard_deviation"):
        m = statistics_match(f"left_{s}", f"right_{s}")
        stats_ok = m if stats_ok is None else stats_ok & m
    return out.select("*", F.coalesce(F.col("left_missing") == F.col("right_missing"),
                                      F.lit(False)).alias("missing_match"),
                      stats_ok.alias("statistics_match"))


def equivalence_from_profiles(left_columns: DataFrame, right_columns: DataFrame,
                              left_binaries: DataFrame, right_binaries: DataFrame,
                              row_count_match: DataFrame, same_column_names: bool,
                              features: Sequence[str]) -> DataFrame:
    """C2 over precomputed profile tables: one row per (check_name, passed).

    The profiles have one row per column, so the verdicts are taken from a
    single collected comparison.
    """
    comp = profile_comparison(None, None, profiles=(left_columns, right_columns)).collect()
    counts = [{r.column_name: (r.count_0, r.count_1) for r in b.collect()}
              for b in (left_binaries, right_binaries)]
    (rows,) = row_count_match.collect()
    checks = [(rows.check_name, bool(rows.passed)), ("column_names", same_column_names),
              ("missing_counts", all(r.missing_match for r in comp)),
              ("binary_counts", counts[0] == counts[1]),
              ("feature_statistics", all(r.statistics_match for r in comp if r.column_name in features))]
    return left_columns.sparkSession.createDataFrame(checks, "check_name string, passed boolean")


def table_equivalence(left: DataFrame, right: DataFrame,
                      spec: ExperimentSpec = ExperimentSpec()) -> DataFrame:
    """Row count, column order, missing counts, binary counts and feature
    statistics agree. One row per check (check_name, passed).

    One aggregate per side holds all that is compared, both at the same time; the checks run on
    those two rows.
    """
    with ThreadPoolExecutor(max_workers=2) as pool:
        a, b = pool.map(lambda side: table_summary(side, spec), (left, right))
    rows = a["table"].crossJoin(b["table"].select(F.col("row_count").alias("other"))).select(
        F.lit("row_count").alias("check_name"), (F.col("row_count") == F.col("other")).alias("passed"))
    return equivalence_from_profiles(a["columns"], b["columns"], a["binaries"], b["binaries"], rows,
                                     left.columns == right.columns, list(spec.features))


def equivalence_passed(checks: DataFrame) -> bool:
    return all(r.passed for r in checks.collect())
