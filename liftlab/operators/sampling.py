"""Exact seeded samples and stratified splits: P1-P5, A9, A10.

Contract: exact sizes, the same rows for the same seed, and independence of
partitioning (``rand(seed)`` depends on the partition layout, ``sample`` is
inexact, and ``orderBy(...).limit(n)`` gathers n rows into one task).

Every unit gets a 60-bit key, the leading digits of the MD5 of "seed:id": any
change of seed or id changes every bit with probability one half, whatever the
id's type, sign or size. A sample of n is the n units with the smallest
(key, id); a split cuts every stratum's (key, id) order in parts.

No row is ranked. Per stratum, rows are counted by the key's top bits; the
counts tell in which bucket a cut falls, and only that bucket's rows (a few
thousand, narrow) are ordered to find the exact (key, id) at the cut. Rows are
then assigned by comparing their key with the boundaries of their stratum: two narrow
scans, and no shuffle of feature columns. Ids must be unique; a repeated id that
shows in a bucket with a cut is an error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftlab.operators.ranking import rank_rows
from liftlab.spec import ExperimentSpec, ValidationError

# Fixed values of the split design.
MINIMUM_STRATUM_ROWS = 5
KEY_BITS = 60
#: Rows per key bucket, about; only buckets with a cut are ordered.
BUCKET_ROWS = 4096
#: Strata whose sizes are computed on the driver; more are computed as a table.
DRIVER_STRATA = 10_000


def sample_key(id_col: Column, seed: int) -> Column:
    """60-bit key of (seed, id): the same in any engine and on any layout."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def sample_key_sql(id_sql: str, seed: int) -> str:
    text = f"'{seed}:' || coalesce(CAST({id_sql} AS VARCHAR), '')"
    return f"CAST('0x' || substr(md5({text}), 1, {KEY_BITS // 4}) AS BIGINT)"


def stratum_key(spec: ExperimentSpec = ExperimentSpec()) -> Column:
    """4 * treatment + 2 * first outcome + second outcome."""
    if len(spec.outcomes) != 2:
        raise ValueError("the stratum key is defined for two outcomes")
    a, b = spec.outcomes
    return (F.col(spec.treatment) * 4 + F.col(a) * 2 + F.col(b)).cast("int")


def _boundaries(keyed: DataFrame, cuts: DataFrame, rows: int) -> DataFrame:
    """The (key, id) of the row at each cut.

    ``keyed``: (stratum, key, id). ``cuts``: (stratum, cut, position), where
    position counts from 1 in the stratum's (key, id) order. Returns (stratum,
    cut, key, id); the result has one row per cut.
    """
    bits = min(40, max(0, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS))))
    bucket = F.shiftright("key", KEY_BITS - bits) if bits else F.lit(0).cast("bigint")
    keyed = keyed.withColumn("bucket", bucket)
    upto = Window.partitionBy("stratum").orderBy("bucket")
    counts = keyed.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "upto", F.sum("n").over(upto))
    at = cuts.withColumnRenamed("stratum", "_s").join(
        counts, F.col("_s").eqNullSafe(F.col("stratum"))
        & (F.col("position") > F.col("upto") - F.col("n")) & (F.col("position") <= F.col("upto")))
    at = at.select(F.col("_s"), F.col("bucket").alias("_b"), "cut",
                   (F.col("position") - F.col("upto") + F.col("n")).alias("place"))
    head = at.limit(DRIVER_STRATA + 1).collect()
    if len(head) <= DRIVER_STRATA:  # a handful of cuts: the buckets are counted once, no row is shuffled to them
        at = F.broadcast(keyed.sparkSession.createDataFrame(head, at.schema))
    wanted = at.select("_s", "_b").distinct()
    if len(head) <= DRIVER_STRATA:
        wanted = F.broadcast(wanted)
    near = keyed.join(wanted, keyed["stratum"].eqNullSafe(wanted["_s"])
                      & (keyed["bucket"] == wanted["_b"])).select("stratum", "bucket", "key", "id")
    order = Window.partitionBy("stratum", "bucket").orderBy("key", "id")
    same = Window.partitionBy("stratum", "bucket", "key", "id")
    near = near.select("*", F.row_number().over(order).alias("nth"),
                       F.count(F.lit(1)).over(same).alias("copies"))
    return near.join(at, near["stratum"].eqNullSafe(at["_s"]) & (near["bucket"] == at["_b"])
                     & (near["nth"] == at["place"])).select("stratum", "cut", "key", "id", "copies")


def _checked(bounds: DataFrame, expected: int | None = None) -> list:
    """Boundary rows on the driver (one per cut), with the uniqueness check."""
    rows = bounds.collect()
    if any(r["copies"] > 1 for r in rows):
        raise ValidationError("Sampling needs unique ids; a cut falls on a repeated id")
    if expected is not None and len(rows) != expected:
        raise ValidationError("A cut could not be located; the input changes between scans")
    return rows


def sample_rows(df: DataFrame, n: int, seed: int, *, id_col: str = "id",
                on_oversize: str = "clamp") -> DataFrame:
    """Exactly ``min(n, N)`` rows (``on_oversize="error"`` refuses n > N)."""
    if n <= 0:
        raise ValueError(f"a sample needs at least one row, not {n}")
    total = df.count()
    if n > total and on_oversize == "error":
        raise ValidationError(f"{n} rows are asked for, the table has {total}")
    if n >= total:
        return df
    keyed = df.select(F.lit(0).alias("stratum"), sample_key(F.col(id_col), seed).alias("key"),
                      F.col(id_col).alias("id"))
    cut = df.sparkSession.createDataFrame([(0, 0, n)], "stratum int, cut int, position long")
    (last,) = _checked(_boundaries(keyed, cut, total), 1)
    key, id_ = sample_key(F.col(id_col), seed), F.col(id_col)
    same = id_.isNull() if last["id"] is None else id_.isNull() | (id_ <= F.lit(last["id"]))
    return df.where((key < last["key"]) | ((key == last["key"]) & same))


def _largest_remainder(sizes: dict, total_take: int) -> dict:
    """Allocate ``total_take`` over strata proportionally; exact integer rule.

    Floors of n_s * take / n, then +1 to the largest remainders (ties: the
    smaller stratum key).
    """
    n = sum(sizes.values())
    if n == 0:
        return {s: 0 for s in sizes}
    base = {s: (c * total_take) // n for s, c in sizes.items()}
    rem = {s: (c * total_take) % n for s, c in sizes.items()}
    extra = total_take - sum(base.values())
    for s in sorted(sizes, key=lambda s: (-rem[s], s is not None, s))[:extra]:
        base[s] += 1
    return base


def split_sizes(sizes: dict, holdout: float = 0.4, second: float = 0.5
                ) -> dict[object, tuple[int, int, int]]:
    """Per stratum (train, validation, test) sizes.

    Mirrors a two-stage stratified split: ``ceil(holdout * n)`` rows leave
    training, then ``ceil(second * holdout_rows)`` of those form the test set.
    """
    n = sum(sizes.values())
    n_hold = math.ceil(holdout * n)
    train = _largest_remainder(sizes, n - n_hold)
    hold = {s: sizes[s] - train[s] for s in sizes}
    n_test = math.ceil(second * n_hold)
    test = _largest_remainder(hold, n_test)
    return {s: (train[s], hold[s] - test[s], test[s]) for s in sizes}


def _allocated(strata: DataFrame, size: str, take: int, out: str) -> DataFrame:
    """:func:`_largest_remainder` over a table of any number of strata."""
    n = strata.agg(F.sum(size)).first()[0] or 0
    product = F.col(size).cast("decimal(38,0)") * F.lit(take)
    base = F.floor(product / F.lit(max(n, 1))).cast("long")
    rest = (product - base.cast("decimal(38,0)") * F.lit(n)).cast("long")
    s = strata.select("*", base.alias("_base"), rest.alias("_rest"))
    extra = take - (s.agg(F.sum("_base")).first()[0] or 0)
    ranked = rank_rows(s, [F.col("_rest").desc(), F.col("stratum").asc()], rank_col="_nth")
    more = F.when(F.col("_nth") <= extra, 1).otherwise(0)
    return ranked.withColumn(out, F.col("_base") + more).drop("_base", "_rest", "_nth")


def _cuts(strata: DataFrame, total: int, holdout: float, second: float) -> DataFrame:
    """(stratum, train_end, validation_end) from (stratum, rows)."""
    spark = strata.sparkSession
    head = strata.limit(DRIVER_STRATA + 1).collect()
    if len(head) <= DRIVER_STRATA:
        sizes = split_sizes({r["stratum"]: r["rows"] for r in head}, holdout, second)
        kind = strata.schema["stratum"].dataType.simpleString()
        return spark.createDataFrame([(s, a, a + b) for s, (a, b, _) in sizes.items()],
                                     f"stratum {kind}, train_end long, validation_end long")
    hold = math.ceil(holdout * total)
    s = _allocated(strata, "rows", total - hold, "train_end")
    s = s.withColumn("_hold", F.col("rows") - F.col("train_end"))
    s = _allocated(s, "_hold", math.ceil(second * hold), "_test")
    return s.select("stratum", "train_end", (F.col("rows") - F.col("_test")).alias("validation_end"))


def stratum_counts(df: DataFrame, spec: ExperimentSpec = ExperimentSpec(),
                   stratum: Column | None = None) -> DataFrame:
    """A10: rows per stratum."""
    key = stratum if stratum is not None else stratum_key(spec)
    return df.groupBy(key.alias("stratum")).agg(F.count(F.lit(1)).alias("rows"))


def split_rows(df: DataFrame, seed: int, *, spec: ExperimentSpec = ExperimentSpec(),
               stratum: Column | None = None, holdout: float = 0.4, second: float = 0.5,
               names: Sequence[str] = ("train", "validation", "test"),
               minimum: int = MINIMUM_STRATUM_ROWS, id_col: str | None = None) -> DataFrame:
    """Add ``split`` (and ``stratum``); every row lands in one split.

    Duplicated rows with ids of their own are separate units and are kept. A
    null stratum key is an error, and so are strata below ``minimum`` rows.
    """
    id_col = id_col or spec.id
    key = stratum if stratum is not None else stratum_key(spec)
    # Three narrow columns, kept for the counts and the cuts: the input may be a join or an aggregate.
    keyed = df.select(key.alias("stratum"), sample_key(F.col(id_col), seed).alias("key"),
                      F.col(id_col).alias("id")).persist(StorageLevel.MEMORY_AND_DISK)
    strata = keyed.groupBy("stratum").agg(F.count(F.lit(1)).alias("rows")).cache()
    try:
        about = strata.agg(F.sum("rows").alias("rows"), F.min("rows").alias("least"),
                           F.count_if(F.col("stratum").isNull()).alias("nulls")).first()
        if not about["rows"]:
            raise ValidationError("there are no rows to split")
        if about["nulls"]:
            raise ValidationError("The stratum key is null for some rows; "
                                  "assignment and outcomes must not be null")
        if about["least"] < minimum:
            raise ValidationError(f"A split stratum has fewer than {minimum} rows; "
                                  "it should contain at least that many")
        ends = _cuts(strata, about["rows"], holdout, second)
        cuts = ends.select("stratum", F.explode(F.array(
            F.struct(F.lit(0).alias("cut"), F.col("train_end").alias("position")),
            F.struct(F.lit(1).alias("cut"), F.col("validation_end").alias("position")))).alias("c")
        ).select("stratum", "c.cut", "c.position")
        found = _boundaries(keyed, cuts.where("position > 0"), about["rows"])
        bound = F.struct("key", "id")
        by_stratum = found.groupBy("stratum").agg(
            F.max(F.when(F.col("cut") == 0, bound)).alias("_first"),
            F.max(F.when(F.col("cut") == 1, bound)).alias("_second"),
            F.max("copies").alias("_copies"))
        head = by_stratum.limit(DRIVER_STRATA + 1).collect()
    finally:
        strata.unpersist()
        keyed.unpersist()
    own = F.struct(F.col("_key").alias("key"), F.col(id_col).alias("id"))
    split = (F.when(F.col("_copies") > 1, F.raise_error(F.lit(
                "Splitting needs unique ids; a cut falls on a repeated id")))
             .when(own <= F.col("_first"), names[0])
             .when(own <= F.col("_second"), names[1]).otherwise(names[2]))
    if len(head) <= DRIVER_STRATA:  # a handful of boundaries: computed once and broadcast
        if any((r["_copies"] or 0) > 1 for r in head):
            raise ValidationError("Splitting needs unique ids; a cut falls on a repeated id")
        by_stratum = F.broadcast(df.sparkSession.createDataFrame(head, by_stratum.schema))
    rows = df.withColumns({"stratum": key, "_key": sample_key(F.col(id_col), seed)})
    return (rows.join(by_stratum, "stratum", "left").withColumn("split", split)
            .select("stratum", *[c for c in df.columns if c != "stratum"], "split"))


def split_summary(split_df: DataFrame, spec: ExperimentSpec = ExperimentSpec()) -> DataFrame:
    """Per split, units, arms and outcome positives / rates by arm."""
    t = F.col(spec.treatment)
    aggs = [F.count(F.lit(1)).alias("observations"),
            F.count_if(t == 1).alias("treatment_count"),
            F.count_if(t == 0).alias("control_count"),
            F.avg(t.cast("double")).alias("treatment_rate")]
    for o in spec.outcomes:
        y = F.col(o)
        aggs += [F.count_if(y == 1).alias(f"{o}_positive"),
                 F.avg(y.cast("double")).alias(f"{o}_rate"),
                 F.count_if((y == 1) & (t == 1)).alias(f"{o}_treatment_positive"),
                 F.avg(F.when(t == 1, y.cast("double"))).alias(f"{o}_treatment_rate"),
                 F.count_if((y == 1) & (t == 0)).alias(f"{o}_control_positive"),
                 F.avg(F.when(t == 0, y.cast("double"))).alias(f"{o}_control_rate")]
    return split_df.groupBy("split").agg(*aggs)
