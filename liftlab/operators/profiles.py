"""Profiles that can be added to: A1 and A3 as stored, mergeable states.

A state is one row per (part, segment, column): counts, minimum, maximum, mean and M2 (the
sum of squared deviations from the mean) over the finite values, and a HyperLogLog sketch of the
distinct values. States of disjoint parts merge without the rows behind them: counts add up, means weigh
by counts, M2 gains ``n (mean - merged mean)^2`` (the pairwise formula, for any number of
parts), sketches unite. Rolling segments up to a table is the same merge.

A table's states come from one aggregate (one scan, partial aggregation). The merge is an
aggregate over the states, so no part or column gathers in one task beyond a row per state.
:class:`ProfileStore` keeps the states of a growing table: only files
that it has not seen are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftlab.operators.validate import INF, _finite, _is_float
from liftlab.sources import versioned
from liftlab.spec import ValidationError

#: 2^12 registers: a relative standard error of about 1.6 %.
LG_K = 12
STATE = ("column_name", "dtype", "row_count", "missing_count", "nonfinite_count", "finite_count",
         "minimum", "maximum", "mean", "m2", "distinct_sketch")


def sketch_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / 2 ** (lg_k / 2)


def _text_of(c: Column, kind: T.DataType) -> Column:
    """Equal values with equal texts: -0.0 is 0.0."""
    return (F.when(c == 0, F.lit(0.0)).otherwise(c) if _is_float(kind) else c).cast("string")


def profile_states(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str | Column] = (),
                   lg_k: int = LG_K) -> DataFrame:
    """States of a table, one row per segment and column (all columns but ``by`` by default).

    Columns that are not numeric have counts and a sketch, and no moments.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = list(columns) if columns is not None else [n for n in df.columns if n not in by]
    aggs = []
    for i, n in enumerate(names):
        c, kind = F.col(f"`{n}`"), kinds[n]
        numeric = isinstance(kind, T.NumericType)
        x = _finite(c, kind).cast("double") if numeric else F.lit(None).cast("double")
        odd = F.count_if(F.isnan(c) | (F.abs(c) == INF)) if _is_float(kind) else F.lit(0).cast("long")
        m2 = F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0))
        aggs.append(F.struct(
            F.lit(n).alias("column_name"), F.lit(kind.simpleString()).alias("dtype"),
            F.count(F.lit(1)).alias("row_count"), F.count_if(c.isNull()).alias("missing_count"),
            odd.alias("nonfinite_count"), F.count(x).alias("finite_count"), F.min(x).alias("minimum"),
            F.max(x).alias("maximum"), F.avg(x).alias("mean"), m2.alias("m2"),
            F.hll_sketch_agg(_text_of(c, kind), lg_k).alias("distinct_sketch")).alias(f"s{i}"))
    wide = df.groupBy(*by).agg(*aggs)
    keys = [c for c in wide.columns if c not in {f"s{i}" for i in range(len(names))}]
    return wide.select(*keys, F.inline(F.array(*[f"s{i}" for i in range(len(names))])))


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of the union of disjoint parts, one row per segment and column."""
    keys = [*by, "column_name"]
    kind = F.when(F.count_distinct("dtype") > 1, F.lit("mixed")).otherwise(F.max("dtype"))
    weighted = F.try_divide(F.sum(F.col("mean") * F.col("finite_count")), F.sum("finite_count"))
    merged = states.groupBy(*keys).agg(
        kind.alias("dtype"), *[F.sum(c).alias(c) for c in STATE[2:6]],
        F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"), weighted.alias("mean"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"))
    means = merged.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("mean").alias("_mean"))
    same = F.lit(True)
    for k in keys:  # segments may be null
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    off = F.col("mean") - F.col("_mean")
    spread = states.join(means, same).groupBy(*keys).agg(
        F.sum(F.col("m2") + F.coalesce(F.col("finite_count") * off * off, F.lit(0.0))).alias("_m2")).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("_m2").alias("m2"))
    return merged.join(spread, same).select(*by, *STATE)


def profile_of(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A1: the profile of numeric columns, as ``validate.column_profile`` gives it."""
    sd = F.sqrt(F.try_divide("m2", "finite_count"))
    return merge_states(states, by).where(~F.col("dtype").isin("string", "boolean", "date", "timestamp", "binary")).select(
        *by, "column_name", "dtype", "missing_count", "nonfinite_count", "minimum", "maximum", "mean",
        sd.alias("standard_deviation"))


def cardinality_of(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A3: estimated distinct non-null values per column, from united sketches."""
    united = states.groupBy(*by, "column_name").agg(F.hll_union_agg("distinct_sketch").alias("s"))
    return united.select(*by, "column_name", F.hll_sketch_estimate("s").alias("cardinality"))


class ProfileStore:
    """States of a growing table, kept at ``path`` (published atomically) per part and segment.

    A part is a file, or any name that the caller gives. Parts are added once: a repeated
    name, or a known file that has changed, is refused, as states cannot be taken back.
    """

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str] = (), lg_k: int = LG_K) -> None:
        self.spark, self.path, self.by, self.lg_k = spark, path.rstrip("/"), list(by), lg_k

    def states(self) -> DataFrame:
        return versioned.read_table(self.spark, f"{self.path}/states")

    def _parts(self) -> DataFrame | None:
        if not versioned.current(self.spark, f"{self.path}/states"):
            return None
        return self.states().select("part", "part_bytes", "part_time").distinct()

    def add(self, df: DataFrame, part: str, columns: Sequence[str] | None = None) -> None:
        """Add a table (or a batch of a stream) under a new name."""
        known = self._parts()
        if known is not None and known.where(F.col("part") == part).take(1):
            raise ValidationError(f"part {part} is in the profile already")
        states = profile_states(df, columns, self.by, self.lg_k)
        self._append(states.select(F.lit(part).alias("part"), F.lit(None).cast("long").alias("part_bytes"),
                                   F.lit(None).cast("timestamp").alias("part_time"), "*"))

    def new_files(self, path: str) -> DataFrame:
        """(path, length, modificationTime) of Parquet files not yet in the profile; only names are listed."""
        files = (self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
                 .option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime"))
        known = self._parts()
        if known is None:
            return files
        both = files.join(known, files["path"] == known["part"], "left")
        changed = both.where(F.col("part").isNotNull() & ~(
            F.col("length").eqNullSafe(F.col("part_bytes"))
            & F.col("modificationTime").eqNullSafe(F.col("part_time")))).select("path").take(5)
        if changed:
            raise ValidationError(f"files changed since they were profiled: {[r['path'] for r in changed]}")
        return both.where(F.col("part").isNull()).select("path", "length", "modificationTime")

    def add_files(self, path: str, columns: Sequence[str] | None = None) -> int:
        """Add the new files below a folder of Parquet files; returns their number. Known files are not opened.

        Paths go through the driver, as in any Spark file listing.
        """
        files = [r["path"] for r in self.new_files(path).collect()]
        if not files:
            return 0
        df = self.spark.read.parquet(*files)
        m = F.col("_metadata")
        tagged = df.withColumns({"_part": m["file_path"], "_part_bytes": m["file_size"],
                                 "_part_time": m["file_modification_time"]})
        names = list(columns) if columns is not None else [c for c in df.columns if c not in self.by]
        states = profile_states(tagged, names, ["_part", "_part_bytes", "_part_time", *self.by], self.lg_k)
        self._append(states.withColumnsRenamed(
            {"_part": "part", "_part_bytes": "part_bytes", "_part_time": "part_time"}))
        return len(files)

    def _append(self, states: DataFrame) -> None:
        versioned.publish_table(states.coalesce(1), f"{self.path}/states", append=True)

    def profile(self, by: Sequence[str] = ()) -> DataFrame:
        return profile_of(self.states(), by)

    def cardinality(self, by: Sequence[str] = ()) -> DataFrame:
        return cardinality_of(self.states(), by)
