"""Ranking and held-out evaluation: R1-R7, A11, M14.

R1, the global rank, is the shared primitive. ``row_number()`` over an
unpartitioned window plans a ``SinglePartition`` exchange (every row in one
task), so it is never used on unit rows. Instead:

1. range-partition on the full sort key and sort inside partitions (the
   key ends with the unique id, so even a score shared by a third of all
   rows is split across partitions by id);
2. write a reliable checkpoint: partition boundaries and order are fixed
   from then on (a recomputation could otherwise re-sample different range
   bounds), and a lost executor re-reads the files instead of re-sorting;
3. count rows per partition (one small aggregate, one row per partition);
4. rank = partition offset (prefix sum over the partition counts, joined
   as a broadcast table of one row per partition) + position in partition.

Evaluations never materialise per-row prefix sums: every rank-based table
(gain curve, targeting policy, deciles) is a difference of cumulative
integer counts at a few cut points. Rows are assigned to the bands between
consecutive cut points (binary search on the rank), counted per band with
map-side partial aggregation, and the cumulative sums run over at most a
few hundred band rows. Sums of the transformed outcome are taken from the
integer counts, so results are exact and independent of summation order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftlab.operators.effects import newcombe_columns
from liftlab.session import drop_checkpoint, ensure_checkpoint_dir, small_table
from liftlab.spec import MINIMUM_CONTROL_EVENTS, TREATMENT_PROPENSITY, ValidationError

# Fixed values of the evaluation design.
TARGETING_FRACTIONS = (0.05, 0.10, 0.20, 0.30, 0.50, 1.00)
CURVE_POINTS = 100
DECILE_GROUPS = 10
CATE_QUANTILES = (0.05, 0.25, 0.50, 0.75, 0.95)
# Rows of a narrow rank input (a few columns) per range partition, at most.
RANK_ROWS_PER_PARTITION = 4_000_000


# ---- R1: distributed global rank -----------------------------------------

def _partitions(spark: SparkSession, n: int | None, rows: int | None = None) -> int | None:
    """Range partitions for a rank.

    ``None`` (the default) leaves the count to Spark: the shuffle setting
    is the upper bound and AQE merges adjacent small range partitions to
    the advisory size, which keeps the order. An explicit ``n`` is used as
    is; a known row count above ``RANK_ROWS_PER_PARTITION`` per shuffle
    partition fixes a larger count.
    """
    if n:
        return int(n)
    base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    if rows and math.ceil(rows / RANK_ROWS_PER_PARTITION) > base:
        return math.ceil(rows / RANK_ROWS_PER_PARTITION)
    return None


def rank_rows_counted(df: DataFrame, order: Sequence[Column], *, rank_col: str = "rank",
                      partitions: int | None = None, check_col: str | None = None,
                      rows: int | None = None) -> tuple[DataFrame, int, int, DataFrame]:
    """:func:`rank_rows` plus the row count and, for ``check_col``, the number
    of null or NaN values, both taken from the per-partition count job, and the
    checkpointed table behind the rank."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    p = _partitions(spark, partitions, rows)
    ranged = df.repartitionByRange(p, *order) if p else df.repartitionByRange(*order)
    ordered = ranged.sortWithinPartitions(*order)
    fixed = ordered.checkpoint(eager=True)
    tagged = fixed.select("*", F.spark_partition_id().alias("_pid"),
                          F.monotonically_increasing_id().alias("_mid"))
    bad = (F.count_if(F.col(check_col).isNull() | F.isnan(check_col)) if check_col
           else F.lit(0).cast("long"))
    counts = sorted((r[0], r[1], r[2]) for r in
                    tagged.groupBy("_pid").agg(F.count(F.lit(1)), bad).collect())
    offsets, running, invalid = [], 0, 0
    for pid, c, b in counts:  # one row per partition: bounded by ``p``
        offsets.append((pid, running))
        running += c
        invalid += b
    schema = T.StructType([T.StructField("_pid", T.IntegerType()),
                           T.StructField("_off", T.LongType())])
    off = spark.createDataFrame(offsets, schema)
    within = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    ranked = (tagged.join(F.broadcast(off), "_pid")
              .withColumn(rank_col, F.col("_off") + within + F.lit(1))
              .drop("_pid", "_mid", "_off"))
    return ranked, running, invalid, fixed


def require_unique_ids(df: DataFrame, id_col: str = "id") -> None:
    """Fail when an id repeats or is null: ranks and cuts would depend on the layout.

    One narrow shuffle of ids with map-side counts.
    """
    ids = df.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    bad = ids.agg(F.count_if(F.col("_n") > 1).alias("repeated"),
                  F.max(F.when(F.col("_id").isNull(), F.col("_n"))).alias("nulls")).first()
    if bad["repeated"] or bad["nulls"]:
        raise ValidationError(f"{id_col} must identify every row: {bad['repeated'] or 0} ids repeat, "
                              f"{bad['nulls'] or 0} are null")


def rank_rows(df: DataFrame, order: Sequence[Column], *, rank_col: str = "rank",
              partitions: int | None = None, rows: int | None = None) -> DataFrame:
    """Append a 1-based global rank following ``order`` (must be a total order).

    Cost: one range shuffle, one checkpoint write, one small count job.
    ``rows`` (if known) sizes the range partitions.
    """
    return rank_rows_counted(df, order, rank_col=rank_col, partitions=partitions,
                             rows=rows)[0]


def descending_score_order(score: str, id_col: str) -> list[Column]:
    """Stable descending order: score desc, ties by id asc. NaN is rejected."""
    return [F.col(score).desc(), F.col(id_col).asc()]


# ---- band counts ------------------------------------------------------------

def band_counts(ranked: DataFrame, cuts: Sequence[int], *, outcome: str, treatment: str,
                score: str, signal: str | None = None, rank_col: str = "rank") -> DataFrame:
    """Integer counts (and score / signal sums) per band (cuts[i-1], cuts[i]].

    ``cuts`` are distinct, increasing, positive and end at N. The band of a
    rank is found by binary search over the cut points (``Bucketizer``).
    """
    splits = [0.5] + [c + 0.5 for c in cuts]
    sig = F.col(signal).cast("double") if signal else F.lit(0.0)
    bands = Bucketizer(splits=splits, inputCol="_r", outputCol="_band").transform(
        ranked.select(F.col(rank_col).cast("double").alias("_r"), outcome, treatment, score,
                      sig.alias("_sig")))
    t, y = F.col(treatment), F.col(outcome)
    return bands.groupBy(F.col("_band").cast("int").alias("band")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(t == 1).alias("tn"), F.count_if(t == 0).alias("cn"),
        F.count_if((t == 1) & (y == 1)).alias("tp"), F.count_if((t == 0) & (y == 1)).alias("cp"),
        F.sum(F.col(score).cast("double")).alias("score_sum"),
        F.sum("_sig").alias("signal_sum"))


def _cumulative(bands: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """Cumulative counts at every cut (plus cut 0), each row also carrying the
    totals (``all_*``). Runs over len(cuts) + 1 rows only."""
    spark = bands.sparkSession
    grid = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cuts)], "band int, cut long")
    full = grid.join(bands, "band", "left").na.fill(0, ["n", "tn", "cn", "tp", "cp"]).na.fill(
        0.0, ["score_sum", "signal_sum"])
    w = Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = full.select("cut", *[F.sum(c).over(w).alias(c) for c in _STATS])
    zero = spark.createDataFrame([(0, 0, 0, 0, 0, 0, 0.0, 0.0)],
                                 "cut long, n long, tn long, cn long, tp long, cp long, "
                                 "score_sum double, signal_sum double")
    cum = cum.unionByName(zero)
    last = int(cuts[-1])
    everything = Window.partitionBy()
    return cum.select("*", *[F.max(F.when(F.col("cut") == last, F.col(c))).over(everything)
                             .alias(f"all_{c}") for c in _STATS])


_STATS = ("n", "tn", "cn", "tp", "cp", "score_sum", "signal_sum")


def _lookup(cum: DataFrame, prefix: str) -> DataFrame:
    return cum.select(F.col("cut").alias(f"{prefix}cut"),
                      *[F.col(c).alias(f"{prefix}{c}") for c in _STATS],
                      *[F.col(f"all_{c}") for c in _STATS])


def curve_counts(n: int, points: int = CURVE_POINTS) -> list[tuple[int, float, int]]:
    """(j, fraction, targeted count) with fraction = j * (1/points), last = 1.0."""
    if points <= 0:
        raise ValueError(f"a curve needs at least one point, not {points}")
    step = 1.0 / points
    out = []
    for j in range(points + 1):
        f = 1.0 if j == points else j * step
        k = 0 if j == 0 else (n if j == points else math.ceil(f * n))
        out.append((j, f, k))
    return out


def policy_counts(n: int, fractions: Sequence[float] = TARGETING_FRACTIONS) -> list[tuple[float, int]]:
    out = []
    for f in fractions:
        if not 0 < f <= 1:
            raise ValueError(f"a targeting fraction lies in (0, 1], {f} does not")
        out.append((float(f), min(n, max(1, math.ceil(f * n)))))
    return out


def decile_bounds(n: int, groups: int = DECILE_GROUPS) -> list[tuple[int, int, int]]:
    """(group, lo, hi] rank ranges with numpy.array_split sizes (larger first)."""
    q, r = divmod(n, groups)
    out, lo = [], 0
    for g in range(groups):
        size = q + (1 if g < r else 0)
        out.append((g + 1, lo, lo + size))
        lo += size
    return out


class RankedEvaluation:
    """Rank a scored held-out table once and derive every rank-based table.

    ``scored`` needs ``id``, ``score``, ``outcome`` and ``treatment``
    columns (names configurable). Ties in score are broken by id ascending;
    ids must be unique, which ``check_ids`` verifies. The evaluation signal is the IPW transformed outcome,
    summed exactly from integer counts; ``signal`` names an explicit signal
    column instead (summed as doubles).
    """

    def __init__(self, scored: DataFrame, *, score: str = "score", outcome: str = "outcome",
                 treatment: str = "treatment", id_col: str = "id",
                 propensity: float = TREATMENT_PROPENSITY, outcome_name: str | None = None,
                 points: int = CURVE_POINTS, fractions: Sequence[float] = TARGETING_FRACTIONS,
                 groups: int = DECILE_GROUPS, partitions: int | None = None,
                 check_scores: bool = True, check_ids: bool = True,
                 signal: str | None = None) -> None:
        if not 0 < propensity < 1:
            raise ValueError(f"propensity must lie between 0 and 1, not {propensity}")
        self.score, self.outcome, self.treatment, self.id_col = score, outcome, treatment, id_col
        self.propensity = propensity
        self.outcome_name = outcome_name or outcome
        self.signal = signal
        narrow = scored.select(id_col, score, outcome, treatment, *([signal] if signal else []))
        if check_ids:
            require_unique_ids(narrow, id_col)
        self.ranked, self.n, invalid, self._checkpoint = rank_rows_counted(
            narrow, descending_score_order(score, id_col), partitions=partitions,
            check_col=score if check_scores else None)
        if invalid:
            raise ValidationError(f"{invalid} scores are null or NaN; ranking needs real numbers")
        if self.n == 0:
            raise ValidationError("there are no scored rows to rank")
        self.curve = curve_counts(self.n, points)
        self.policy = policy_counts(self.n, fractions)
        self.deciles = decile_bounds(self.n, groups)
        cuts = sorted({k for _, _, k in self.curve if k > 0}
                      | {k for _, k in self.policy}
                      | {hi for _, _, hi in self.deciles if hi > 0})
        bands = band_counts(self.ranked, cuts, outcome=outcome, treatment=treatment, score=score,
                            signal=signal)
        self.cum = _cumulative(bands, cuts).cache()
        self._spark = scored.sparkSession

    # -- helpers --
    def _z_total(self, prefix: str) -> Column:
        """Sum of the signal over the rows behind a cumulative lookup."""
        if self.signal:
            return F.col(f"{prefix}signal_sum")
        p = self.propensity
        return F.col(f"{prefix}tp") / F.lit(p) - F.col(f"{prefix}cp") / F.lit(1.0 - p)

    # -- R2 / R3 --
    def gain_curve(self) -> DataFrame:
        """Policy and random cumulative gain per 100,000 at points+1 fractions."""
        pts = self._spark.createDataFrame(self.curve, "point int, fraction double, k long")
        at = _lookup(self.cum, "c_")
        joined = pts.join(at, pts.k == at.c_cut)
        treat_all = self._z_total("all_") / F.lit(self.n) * 100000.0
        policy = self._z_total("c_") / F.lit(self.n) * 100000.0
        return joined.select(
            "point", "fraction", F.col("k").alias("targeted_count"),
            policy.alias("policy_gain_per_100000"),
            (F.col("fraction") * treat_all).alias("random_gain_per_100000"),
            treat_all.alias("treat_all_gain_per_100000"))

    def auuc(self) -> DataFrame:
        """Trapezoid area between the policy and random curves."""
        curve = self.gain_curve().withColumn(
            "d", F.col("policy_gain_per_100000") - F.col("random_gain_per_100000"))
        w = Window.orderBy("point")  # points+1 rows only
        seg = curve.select(
            "d", "fraction", "treat_all_gain_per_100000",
            F.lag("d").over(w).alias("d0"), F.lag("fraction").over(w).alias("f0"))
        return seg.agg(
            F.sum(F.when(F.col("d0").isNotNull(),
                         (F.col("d0") + F.col("d")) / 2.0 * (F.col("fraction") - F.col("f0")))
                  ).alias("auuc_above_random_per_100000"),
            F.first("treat_all_gain_per_100000").alias("treat_all_gain_per_100000"),
            F.lit(self.n).cast("bigint").alias("observations"))

    # -- R4 --
    def targeting_policy(self, alpha: float = 0.05) -> DataFrame:
        pol = self._spark.createDataFrame(self.policy, "fraction double, targeted_count long")
        at = _lookup(self.cum, "c_")
        joined = pol.join(at, pol.targeted_count == at.c_cut)
        grp = newcombe_columns(F.col("c_tp"), F.col("c_tn"), F.col("c_cp"), F.col("c_cn"), alpha)
        all_ = newcombe_columns(F.col("all_tp"), F.col("all_tn"), F.col("all_cp"),
                                F.col("all_cn"), alpha)
        share = F.col("targeted_count") / F.lit(self.n)
        policy = grp["observed_difference"] * share * 100000.0
        random = all_["observed_difference"] * share * 100000.0
        flag = (F.lit(self.outcome_name == "conversion")
                & (F.col("c_cp") < MINIMUM_CONTROL_EVENTS))
        return joined.select(
            "fraction", "targeted_count",
            grp["observed_difference"].alias("estimated_incremental_outcome_rate_among_targeted"),
            policy.alias("incremental_outcomes_per_100000_population"),
            random.alias("random_targeting_per_100000_population"),
            (policy - random).alias("incremental_outcomes_above_random_per_100000"),
            (self._z_total("c_") / F.col("targeted_count")
             ).alias("ipw_transformed_outcome_rate_among_targeted"),
            *[c.alias(k) for k, c in grp.items()],
            flag.alias("insufficient_control_events"),
            F.lit(MINIMUM_CONTROL_EVENTS).alias("control_event_threshold"))

    # -- R5 --
    def uplift_deciles(self, alpha: float = 0.05) -> DataFrame:
        dec = self._spark.createDataFrame(self.deciles, "rank int, lo long, hi long")
        lo = _lookup(self.cum, "lo_").drop(*[f"all_{c}" for c in _STATS])
        hi = _lookup(self.cum, "hi_")
        joined = dec.join(lo, dec.lo == lo.lo_cut).join(hi, dec.hi == hi.hi_cut)
        d = {c: F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in
             ("n", "tn", "cn", "tp", "cp", "score_sum")}
        grp = newcombe_columns(d["tp"], d["tn"], d["cp"], d["cn"], alpha)
        flag = F.lit(self.outcome_name == "conversion") & (d["cp"] < MINIMUM_CONTROL_EVENTS)
        return joined.select(
            "rank", d["n"].alias("observations"),
            F.try_divide(d["score_sum"], d["n"]).alias("mean_predicted_uplift"),
            *[c.alias(k) for k, c in grp.items()],
            flag.alias("insufficient_control_events"),
            F.lit(MINIMUM_CONTROL_EVENTS).alias("control_event_threshold"))

    # -- A11 --
    def _quantile_plan(self, probs: Sequence[float]) -> list[tuple[float, int, int, float]]:
        """(q, descending rank of x[lo], of x[hi], weight) for numpy's linear rule."""
        n, out = self.n, []
        for q in probs:
            h = (n - 1) * q
            lo = math.floor(h)
            hi = min(lo + 1, n - 1)
            out.append((float(q), n - lo, n - hi, h - lo))
        return out

    def cate_summary(self, held_out_test_ate: float | None = None,
                     full_benchmark_itt: float | None = None) -> DataFrame:
        """Distribution of the predicted uplift: moments, exact quantiles, signs.

        One aggregate over the ranked rows: quantiles are the scores at known
        ranks, picked with conditional aggregates, then interpolated.
        """
        s, r = F.col(self.score), F.col("rank")
        names = ["percentile_05", "percentile_25", "median", "percentile_75", "percentile_95"]
        plan = self._quantile_plan(CATE_QUANTILES)
        aggs = [F.avg(s).alias("mean"), F.stddev_pop(s).alias("standard_deviation"),
                F.min(s).alias("minimum"), F.max(s).alias("maximum"),
                F.avg(F.when(s > 0, 1.0).otherwise(0.0)).alias("proportion_positive"),
                F.avg(F.when(s < 0, 1.0).otherwise(0.0)).alias("proportion_negative"),
                F.count_if(F.col(self.treatment) == 1).alias("_tn"),
                F.count_if(F.col(self.treatment) == 0).alias("_cn"),
                F.count_if((F.col(self.treatment) == 1) & (F.col(self.outcome) == 1)).alias("_tp"),
                F.count_if((F.col(self.treatment) == 0) & (F.col(self.outcome) == 1)).alias("_cp")]
        for i, (_, r_lo, r_hi, _) in enumerate(plan):
            aggs += [F.max(F.when(r == r_lo, s)).alias(f"_lo{i}"),
                     F.max(F.when(r == r_hi, s)).alias(f"_hi{i}")]
        row = self.ranked.agg(*aggs)
        qcols = []
        for i, (_, _, _, frac) in enumerate(plan):
            a, b = F.col(f"_lo{i}"), F.col(f"_hi{i}")
            v = b - (b - a) * (1 - frac) if frac >= 0.5 else a + (b - a) * frac
            qcols.append(v.alias(names[i]))
        ate = newcombe_columns(F.col("_tp"), F.col("_tn"), F.col("_cp"), F.col("_cn"))[
            "observed_difference"]
        test_ate = F.lit(held_out_test_ate) if held_out_test_ate is not None else ate
        res = row.select("mean", "standard_deviation", "minimum", *qcols, "maximum",
                         "proportion_positive", "proportion_negative",
                         test_ate.alias("held_out_test_ate"))
        res = res.withColumn("mean_minus_held_out_test_ate",
                             F.col("mean") - F.col("held_out_test_ate"))
        if full_benchmark_itt is not None:
            res = res.withColumn("full_benchmark_itt", F.lit(float(full_benchmark_itt))).withColumn(
                "mean_minus_full_benchmark_itt", F.col("mean") - F.col("full_benchmark_itt"))
        return res

    def release(self) -> None:
        """Give back the band counts and the rank's checkpoint files.

        Tables taken from this evaluation must have been computed before.
        """
        self.cum.unpersist()
        drop_checkpoint(self._checkpoint)


# ---- A11 without a sort ------------------------------------------------------

#: Width of the quantile sketch; its rank error falls as its inverse.
SKETCH_K = 4000


def quantile_rank_error(k: int = SKETCH_K) -> float:
    """Normalised rank error of a KLL sketch of width ``k``, which 99 of 100 quantiles keep."""
    return 2.296 / k ** 0.9723


def cate_distribution(scored: DataFrame, *, score: str = "score", outcome: str = "outcome",
                      treatment: str = "treatment", k: int = SKETCH_K,
                      held_out_test_ate: float | None = None,
                      full_benchmark_itt: float | None = None) -> DataFrame:
    """A11 with sketched quantiles: the columns of ``cate_summary`` and ``rank_error``.

    Moments, signs and the quantile sketch come from one aggregate, so no sort
    and no shuffle of rows takes place. Every other column is exact.
    """
    s, t, y = F.col(score).cast("double"), F.col(treatment), F.col(outcome)
    bad = F.col("_bad") > 0
    row = scored.agg(
        F.avg(s).alias("mean"), F.stddev_pop(s).alias("standard_deviation"), F.min(s).alias("minimum"),
        F.max(s).alias("maximum"), F.avg(F.when(s > 0, 1.0).otherwise(0.0)).alias("proportion_positive"),
        F.avg(F.when(s < 0, 1.0).otherwise(0.0)).alias("proportion_negative"),
        F.count_if(t == 1).alias("_tn"), F.count_if(t == 0).alias("_cn"),
        F.count_if((t == 1) & (y == 1)).alias("_tp"), F.count_if((t == 0) & (y == 1)).alias("_cp"),
        F.count_if(s.isNull() | F.isnan(s)).alias("_bad"), F.count(F.lit(1)).alias("_n"),
        F.kll_sketch_agg_double(F.when(~F.isnan(s), s), k).alias("_kll"))
    fail = F.when(bad, F.raise_error(F.lit("scores are null or NaN; a distribution needs real numbers"))).when(
        F.col("_n") == 0, F.raise_error(F.lit("there are no scored rows")))
    names = ["percentile_05", "percentile_25", "median", "percentile_75", "percentile_95"]
    at = [F.coalesce(fail.cast("double"), F.kll_sketch_get_quantile_double("_kll", F.lit(float(q)))).alias(n)
          for q, n in zip(CATE_QUANTILES, names)]
    ate = newcombe_columns(F.col("_tp"), F.col("_tn"), F.col("_cp"), F.col("_cn"))["observed_difference"]
    test_ate = F.lit(held_out_test_ate) if held_out_test_ate is not None else ate
    out = row.select("mean", "standard_deviation", "minimum", *at, "maximum", "proportion_positive",
                     "proportion_negative", test_ate.alias("held_out_test_ate"))
    out = out.withColumn("mean_minus_held_out_test_ate", F.col("mean") - F.col("held_out_test_ate"))
    if full_benchmark_itt is not None:
        out = out.withColumn("full_benchmark_itt", F.lit(float(full_benchmark_itt))).withColumn(
            "mean_minus_full_benchmark_itt", F.col("mean") - F.col("full_benchmark_itt"))
    return out.withColumn("rank_error", F.lit(quantile_rank_error(k)))


def quantile_ranks(scored: DataFrame, summary: DataFrame, *, score: str = "score",
                   tolerance: float) -> DataFrame:
    """Check of sketched quantiles by exact counts: one row per probability.

    A value stands at the ranks from the share of rows below it to the share not above it;
    ``within`` says whether the probability is in that range, widened by ``tolerance``.
    """
    names = ["percentile_05", "percentile_25", "median", "percentile_75", "percentile_95"]
    values = summary.select(*names).first()  # one row
    s = F.col(score).cast("double")
    wide = scored.agg(F.count(F.lit(1)).alias("n"), *[x for i, n in enumerate(names) for x in (
        F.count_if(s < values[n]).alias(f"below_{i}"), F.count_if(s <= values[n]).alias(f"upto_{i}"))])
    rows = F.array(*[F.struct(F.lit(float(q)).alias("probability"), F.col(f"below_{i}").alias("below"),
                              F.col(f"upto_{i}").alias("upto")) for i, q in enumerate(CATE_QUANTILES)])
    q = F.col("probability")
    return wide.select("n", F.inline(rows)).select(
        "probability", F.col("n").alias("observations"),
        ((q >= F.col("below") / F.col("n") - tolerance) & (q <= F.col("upto") / F.col("n") + tolerance)).alias("within"))


# ---- M12: the area of many candidates from one sort ---------------------------

def candidate_auuc(scores: DataFrame, *, candidate: str = "candidate", score: str = "score",
                   outcome: str = "outcome", treatment: str = "treatment", id_col: str = "id",
                   propensity: float = TREATMENT_PROPENSITY, points: int = CURVE_POINTS,
                   partitions: int | None = None) -> DataFrame:
    """Area above random of every candidate in a long table of (candidate, id, score, ...).

    One range sort on (candidate, score desc, id) ranks the rows of all candidates: a row's rank
    is its place in the partition plus the rows of its candidate in earlier partitions. Partition
    and candidate totals (at most partitions + candidates rows) go through the driver, as do the
    areas. Bands are counted per candidate with map-side combine.
    """
    if not 0 < propensity < 1:
        raise ValueError(f"propensity must lie between 0 and 1, not {propensity}")
    spark = scores.sparkSession
    ensure_checkpoint_dir(spark)
    order = [F.col("_c").asc(), F.col("_s").desc(), F.col("_i").asc()]
    rows = scores.select(F.col(candidate).alias("_c"), F.col(score).cast("double").alias("_s"),
                         F.col(id_col).alias("_i"), F.col(outcome).alias("_y"), F.col(treatment).alias("_t"))
    p = _partitions(spark, partitions)
    ranged = rows.repartitionByRange(p, *order) if p else rows.repartitionByRange(*order)
    fixed = ranged.sortWithinPartitions(*order).checkpoint(eager=True)
    tagged = fixed.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    counts = tagged.groupBy("_c", "_pid").agg(
        F.count(F.lit(1)).alias("n"), F.min("_mid").alias("lo"),
        F.count_if(F.col("_s").isNull() | F.isnan("_s")).alias("bad")).collect()
    if sum(r["bad"] for r in counts):
        raise ValidationError(f"{sum(r['bad'] for r in counts)} scores are null or NaN; ranking needs real numbers")
    if not counts:
        raise ValidationError("there are no scored rows to rank")
    offsets, sizes = [], {}
    for r in sorted(counts, key=lambda r: r["_pid"]):
        offsets.append((r["_c"], r["_pid"], sizes.get(r["_c"], 0) - r["lo"]))
        sizes[r["_c"]] = sizes.get(r["_c"], 0) + r["n"]
    kind = scores.schema[candidate].dataType.simpleString()
    off = spark.createDataFrame(offsets, f"_c {kind}, _pid int, _off long")
    ranked = tagged.join(F.broadcast(off), ["_c", "_pid"]).withColumn(
        "rank", F.col("_mid") + F.col("_off") + F.lit(1))
    counted = {}
    for n in sorted(set(sizes.values())):  # candidates score the same rows: one size
        cuts = sorted({k for _, _, k in curve_counts(n, points) if k > 0})
        of = [c for c, m in sizes.items() if m == n]
        same = ranked if len(of) == len(sizes) else ranked.where(F.col("_c").isin(of))
        bands = Bucketizer(splits=[0.5] + [c + 0.5 for c in cuts], inputCol="_r", outputCol="_band").transform(
            same.select("_c", F.col("rank").cast("double").alias("_r"), "_y", "_t"))
        pos = F.col("_y") == 1
        for r in bands.groupBy("_c", F.col("_band").cast("int").alias("band")).agg(
                F.count_if(pos & (F.col("_t") == 1)).alias("tp"),
                F.count_if(pos & (F.col("_t") == 0)).alias("cp")).collect():  # bands x candidates
            counted.setdefault(r["_c"], {})[cuts[r["band"]]] = (r["tp"], r["cp"])
    drop_checkpoint(fixed)
    out = []
    for c, n in sizes.items():
        tp = cp = 0
        reached = {0: (0, 0)}
        for k in sorted(counted[c]):
            tp, cp = tp + counted[c][k][0], cp + counted[c][k][1]
            reached[k] = (tp, cp)
        gain = lambda tp, cp: (tp / propensity - cp / (1.0 - propensity)) / n * 100000.0
        whole, area, last = gain(tp, cp), 0.0, None
        for _, share, k in curve_counts(n, points):
            d = gain(*reached[k]) - share * whole
            if last is not None:
                area += (last[0] + d) / 2.0 * (share - last[1])
            last = (d, share)
        out.append((c, area, whole, n))
    return spark.createDataFrame(out, f"{candidate} {kind}, auuc_above_random_per_100000 double, "
                                      "treat_all_gain_per_100000 double, observations long")


# ---- M14: factual predictive diagnostics -------------------------------------

def prefix_sums(df: DataFrame, order: Sequence[str], sums: Mapping[str, str]
                ) -> tuple[DataFrame, DataFrame]:
    """Add, for each (new column: column), the sum over all rows before a row.

    ``order`` must be a total order. Rows are range-sorted and checkpointed;
    sums run within partitions, and the partitions' totals (one row each) give
    the offsets. Also returns the checkpointed table, to be dropped after use.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    fixed = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint(eager=True)
    tagged = fixed.withColumn("_pid", F.spark_partition_id())
    totals = tagged.groupBy("_pid").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).orderBy("_pid").collect()
    offsets, running = [], {n: 0 for n in sums}
    for r in totals:  # one row per partition
        offsets.append((r["_pid"], *running.values()))
        running = {n: running[n] + (r[n] or 0) for n in sums}
    off = spark.createDataFrame(offsets, "_pid int, " + ", ".join(f"`_off_{n}` long" for n in sums))
    before = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = tagged.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_in_{n}") for n, c in sums.items()])
    return out.join(F.broadcast(off), "_pid").select(
        *df.columns, *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(n) for n in sums]), fixed


def _auc(wins2: Column, n1: Column, n0: Column) -> Column:
    """AUC from twice the number of (positive, lower negative) pairs, ties counting once."""
    pairs = n1.cast("double") * n0.cast("double")
    return F.when(pairs > 0, wins2.cast("double") / (2.0 * pairs))


def _wins2(pos: str, neg: str, below: str) -> Column:
    """Twice the negatives beaten by a tie group's positives; exact beyond bigint."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return F.sum(wide(pos) * (wide(below) * 2 + wide(neg)))


def rank_auc(df: DataFrame, prob: str, label: str, group: str) -> DataFrame:
    """ROC AUC per group by Mann-Whitney pair counts, ties counting one half.

    Rows are first counted per (group, probability); the negatives below each
    such tie group come from distributed prefix sums. Null with one class. Groups
    are evaluation groups (arms, splits): the result is a local table.
    """
    y = F.col(label)
    ties = df.groupBy(F.col(group).alias("_g"), F.col(prob).alias("_p")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    sums, fixed = prefix_sums(ties, ["_g", "_p"], {"below": "neg"})
    per = sums.groupBy("_g").agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0"),
                                 F.min("below").alias("first"), _wins2("pos", "neg", "below").alias("w"))
    # Negatives of earlier groups are below every row of this one.
    own = F.col("w") - F.lit(2) * F.col("n1").cast("decimal(19,0)") * F.col("first").cast("decimal(19,0)")
    out = small_table(per.select(F.col("_g").alias(group), "n1", "n0",
                                 _auc(own, F.col("n1"), F.col("n0")).alias("roc_auc")))
    drop_checkpoint(fixed)
    return out


def log_loss_col(y: Column, p: Column) -> Column:
    return -(y * F.log(p) + (F.lit(1) - y) * F.log(F.lit(1.0) - p))


def predictive_diagnostics(scored: DataFrame, *, outcome: str = "outcome",
                           treatment: str = "treatment", p1: str = "p1", p0: str = "p0",
                           id_col: str = "id") -> DataFrame:
    """Factual AUC / log loss: overall (p1 for treated, p0 for control),
    treated rows on p1, control rows on p0. One row per group."""
    t, y = F.col(treatment), F.col(outcome)
    factual = F.when(t == 1, F.col(p1)).otherwise(F.col(p0))
    base = scored.select(factual.alias("_p"), t.alias("_t"), y.alias("_y"))
    loss = log_loss_col(F.col("_y"), F.col("_p"))
    arms = {"treated_p1": F.col("_t") == 1, "control_p0": F.col("_t") == 0}
    pos, neg = F.col("_y") == 1, F.col("_y") == 0
    # One row per factual probability: counts and losses of both arms. Nothing is stacked.
    ties = base.groupBy("_p").agg(
        *[F.count_if(c & pos).alias(f"pos_{a}") for a, c in arms.items()],
        *[F.count_if(c & neg).alias(f"neg_{a}") for a, c in arms.items()],
        *[F.count_if(c).alias(f"n_{a}") for a, c in arms.items()],
        *[F.coalesce(F.sum(F.when(c, loss)), F.lit(0.0)).alias(f"loss_{a}") for a, c in arms.items()])
    ties = ties.withColumns({f"{k}_overall": F.col(f"{k}_treated_p1") + F.col(f"{k}_control_p0")
                             for k in ("pos", "neg", "n", "loss")})
    groups = ("overall", "treated_p1", "control_p0")
    sums, fixed = prefix_sums(ties, ["_p"], {f"below_{g}": f"neg_{g}" for g in groups})
    wide = sums.agg(*[x for g in groups for x in (
        F.sum(f"n_{g}").alias(f"n_{g}"), F.sum(f"pos_{g}").alias(f"pos_{g}"),
        F.sum(f"neg_{g}").alias(f"neg_{g}"), F.sum(f"loss_{g}").alias(f"loss_{g}"),
        _wins2(f"pos_{g}", f"neg_{g}", f"below_{g}").alias(f"w_{g}"))])
    rows = F.array(*[F.struct(
        F.lit(g).alias("group"), F.col(f"n_{g}").alias("observations"), F.col(f"pos_{g}").alias("positive"),
        F.try_divide(F.col(f"loss_{g}"), F.col(f"n_{g}")).alias("log_loss"),
        _auc(F.col(f"w_{g}"), F.col(f"pos_{g}"), F.col(f"neg_{g}")).alias("roc_auc")) for g in groups])
    out = small_table(wide.select(F.explode(rows).alias("r")).select("r.*").where("observations > 0"))
    drop_checkpoint(fixed)
    return out


def clip_probability(c: Column, eps: float = 1e-7) -> Column:
    """M6: positive probability clipped to [eps, 1 - eps]."""
    return F.least(F.greatest(c, F.lit(eps)), F.lit(1.0 - eps))
