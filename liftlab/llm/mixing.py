"""Mix sources to target weights along a time-varying curriculum.

Every source gets a token target (its share of all sizes by weight, at most
``cap`` times its own size, the excess reshared by weight). The source's
documents form a stream in a fixed pseudo-random order that is read again
and again until the target is met. A weight schedule says how the source's
demand is spread over training time; its integral is the cumulative demand,
and inverting that at a document's place in the stream gives the document's
training position. Sorting by position by range gives the training order.

Defined cases. Null text or blank text: size 0, never repeated, takes nothing.
Null source: a source of its own, after all others. Null or repeated doc_id:
ordinary rows, ordered by the hash of their id, by size and by a hash of their columns
(nested ones aside); repeated rows are mixed like different documents. A document longer than its source's target
is taken when more than half of it fits. A source of size 0 gets target 0. An
empty table gives an empty result. Other columns are carried through ``mix``
untouched; its own columns (OWN_COLUMNS) come last, with leading underscores where the table has
such names already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from liftlab.llm.common import fresh, ranked, shuffle_partitions, stored, table, words

OWN_COLUMNS = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_positions")
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
#: Relative weight over training time, at equally spaced times, for each weight
#: of the cycle: large sources lead, small ones follow.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS,
                   cap: float = CAP) -> DataFrame:
    """(source, source_size) -> plus tier and target, by capped water filling.

    ``target = min(cap * source_size, level * weight)`` where the level makes
    the targets sum to all sizes. The level is raised until no further source
    reaches its cap; each round is one aggregate over the sources, one row of
    which reaches the driver.
    """
    s = sources.select("source", "source_size", F.col("source").isNull().alias("_null"))
    s = ranked(stored(s, "mix-sources"), ["_null", "source"], "mix-source-order", "_nth")
    tier = F.pmod(F.col("_nth"), F.lit(len(weights))).cast("int")
    s = s.select("source", "source_size", tier.alias("tier"))
    s = s.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.col("tier") + 1))
    most = F.lit(cap) * F.col("source_size")
    level, seen = None, -1
    while True:
        capped = F.lit(False) if level is None else F.col("_w") * level >= most
        r = s.agg(F.sum("source_size").alias("all"),
                  F.sum(F.when(capped, most)).alias("full"),
                  F.sum(F.when(~capped, F.col("_w"))).alias("w"),
                  F.count_if(capped).alias("n")).first()
        if r["all"] is None or r["w"] is None or r["n"] == seen:
            break
        seen, level = r["n"], (r["all"] - (r["full"] or 0)) / r["w"]
    target = most if level is None else F.least(F.col("_w") * level, most)
    return s.select("source", "source_size", "tier", target.cast("double").alias("target"))


def time_of(share: Column, knots: Sequence[float]) -> Column:
    """Training time (0 to 1) at which a schedule has spent ``share`` of its integral."""
    m = len(knots) - 1
    areas = [(a + b) / (2 * m) for a, b in zip(knots, knots[1:])]
    whole, before, out = sum(areas), 0.0, None
    for j, area in enumerate(areas):
        rest = F.greatest(share * whole - before, F.lit(0.0))
        slope = (knots[j + 1] - knots[j]) * m
        step = 2 * rest / (knots[j] + F.sqrt(knots[j] * knots[j] + 2 * slope * rest))
        here = F.lit(j / m) + step
        before += area
        out = (F.when(share * whole <= before, here) if out is None else
               out.when(share * whole <= before, here) if j < m - 1 else out.otherwise(here))
    return out if m > 1 else here


def _in_stream_order(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """(of, size, ...) plus ``begin``: the sizes before a row in its source, in ``order``.

    One range sort of narrow rows over all sources; running sums within a
    range; and the ranges' totals, at most one per range and source.
    ``order`` ends in a unique column, so no key is too frequent to be cut.
    """
    ranged = (rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "of", *order)
              .sortWithinPartitions("of", *order).withColumn("at", F.monotonically_increasing_id()))
    ranged = stored(ranged, "mix-ranges").withColumn("range", F.shiftright("at", 33))
    earlier = Window.partitionBy("of").orderBy("range")
    starts = (ranged.groupBy("of", "range").agg(F.sum("size").alias("sum"))
              .withColumn("start", F.sum("sum").over(earlier) - F.col("sum")).drop("sum"))
    so_far = (Window.partitionBy("range", "of").orderBy("at")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = ranged.withColumn("end", F.sum("size").over(so_far))
    return (ends.join(starts, ["range", "of"])
            .withColumn("begin", F.col("start") + F.col("end") - F.col("size"))
            .drop("range", "at", "start", "end"))


def mix(docs: DataFrame, size: Column, weights: Sequence[float] = WEIGHTS, cap: int = CAP,
        schedules: Sequence[Sequence[float]] = SCHEDULES) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target, mix_copies, mix_positions.

    ``docs`` needs doc_id and source. mix_positions holds the training
    position of every copy. The rows are stored under a number; everything else
    is computed on narrow rows, and the result is joined to them once.
    """
    own = fresh(docs.columns, *OWN_COLUMNS)
    plain = [f.name for f in docs.schema if not isinstance(
        f.dataType, (ArrayType, MapType, StructType, VariantType))]
    # md5 of the id: the same order in any engine and on any layout.
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # A source key without nulls: windows and joins then share one partitioning.
    of = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    rows = stored(docs.select(F.struct(*docs.columns).alias("row"), "source", of.alias("of"),
                              size.cast("long").alias("size"), key.alias("key"),
                              F.xxhash64(*plain).alias("hash"),
                              F.monotonically_increasing_id().alias("number")), "mix-rows")
    totals = stored(rows.groupBy("of").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")),
                    "mix-totals")
    targets = source_targets(totals, weights, cap).withColumn("of", of).drop("source")
    d = _in_stream_order(rows.select("of", "key", "size", "hash", "number"), ["key", "size", "hash", "number"])
    d = d.join(targets, "of")
    # Copy p occupies [p * source_size + begin, + size): taken if its middle is below target.
    fits = F.ceil((F.col("target") - F.col("begin") - F.col("size") / 2) / F.col("source_size"))
    once = F.when(F.col("begin") < F.col("target"), 1).otherwise(0)
    d = d.withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(cap), F.when(
        F.col("size") > 0, fits).otherwise(once))).cast("int"))

    def position(p: Column) -> Column:
        share = F.least(F.lit(1.0), (p * F.col("source_size") + F.col("begin")) / F.col("target"))
        out = time_of(share, schedules[0])
        for k in range(1, len(schedules)):
            out = F.when(F.col("tier") % len(schedules) == k, time_of(share, schedules[k])).otherwise(out)
        return out

    positions = F.array_compact(F.array(*[F.when(F.col("copies") > p, position(F.lit(p)))
                                          for p in range(cap)]))
    d = d.select("number", *[c.alias(n) for n, c in zip(own, (
        F.col("size"), F.col("source_size"), F.col("target"), F.col("copies"), positions))])
    return rows.select("number", "row").join(d, "number").select("row.*", *own)


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy of a result of ``mix``, range-sorted by position; the columns of ``mix`` go."""
    own = mixed.columns[-len(OWN_COLUMNS):]
    (position,) = fresh(mixed.columns, "_position")
    rows = mixed.withColumn(position, F.explode(own[-1])).drop(*own)
    return rows.orderBy(position, "doc_id").drop(position)


def n_words(text: Column) -> Column:
    return F.size(words(text))


def places(positions: DataFrame) -> DataFrame:
    """(row, doc_id, size, copy, tick) -> plus ``place``, from 0, in training order.

    A tick is a billionth of the training time. Copies of one tick are ordered by doc_id
    (null first), size and copy.
    """
    return ranked(stored(positions, "mix-copies"), ["tick", "doc_id", "size", "copy", "row"], "mix-order", "place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("n"))
    numbered = stored(docs.withColumn("row", F.monotonically_increasing_id()), "mix-docs")
    m = stored(mix(numbered, F.col("n")), "mix-result")
    copies = m.select("row", "doc_id", F.col("mix_size").alias("size"),
                      F.posexplode("mix_positions").alias("copy", "position"))
    placed = places(copies.withColumn("tick", F.round(F.col("position") * 1e9).cast("long")).drop("position"))
    found = placed.groupBy("row").agg(*[F.max(F.when(F.col("copy") == p, F.col("place"))).alias(f"place_{p + 1}")
                                        for p in range(CAP)])
    return m.join(found, "row", "left").select(
        "doc_id", F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.round("mix_target", 4).alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
        F.round(F.try_element_at("mix_positions", F.lit(1)), 9).alias("position"),
        *[F.col(f"place_{p + 1}") for p in range(CAP)])


def _time_sql(knots: Sequence[float]) -> str:
    m = len(knots) - 1
    areas = [(a + b) / (2 * m) for a, b in zip(knots, knots[1:])]
    whole, before, out = sum(areas), 0.0, ""
    for j, area in enumerate(areas):
        rest = f"greatest(share * {whole!r}::double - {before!r}::double, 0)"
        slope = (knots[j + 1] - knots[j]) * m
        here = (f"{j / m!r}::double + 2 * {rest} / ({knots[j]!r}::double + sqrt("
                f"{knots[j] * knots[j]!r}::double + {2 * slope!r}::double * {rest}))")
        before += area
        out += (f" when share * {whole!r}::double <= {before!r}::double then {here}"
                if j < m - 1 else f" else {here}")
    return f"case {out} end"


def oracle() -> str:
    """DuckDB: the level by sorting sources by the level at which they are full."""
    cases = " ".join(f"when tier = {k} then {_time_sql(s)}" for k, s in enumerate(SCHEDULES))
    each = ", ".join(f"max(case when copy = {p} then place end) as place_{p + 1}" for p in range(CAP))
    found = ", ".join(f"x.place_{p + 1}::bigint as place_{p + 1}" for p in range(CAP))
    return f"""
with d as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as k,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         (row_number() over (order by source is null, source) - 1) % {len(WEIGHTS)} as tier
  from d group by source),
w as (select *, list_extract({list(WEIGHTS)!r}, (tier + 1)::int)::double as w from s),
f as (  -- caps filled by sources that are full at a lower level
  select *, {CAP} * source_size / w as fills_at,
         sum({CAP} * source_size) over o as filled, sum(w) over () - sum(w) over o as open_w,
         (select sum(size) from d) as total
  from w window o as (order by {CAP} * source_size / w rows unbounded preceding)),
l as (
  select coalesce(min(level), 0) as level from (
    select case when open_w > 0 then (total - filled) / open_w end as level,
           lead(fills_at) over (order by fills_at) as next_at, fills_at
    from (select fills_at, filled, open_w, total from f
          union all select 0, 0, (select sum(w) from w), (select sum(size) from d)))
  where level >= fills_at and (next_at is null or level <= next_at)),
t as (
  select source, source_size, tier, least({CAP} * source_size, w * level)::double as target
  from w, l),
p as (
  select d.*, t.source_size, t.tier, t.target,
         sum(size) over (partition by d.source order by k, size
                         rows unbounded preceding) - size as b
  from d join t on d.source is not distinct from t.source),
c as (
  select *, greatest(0, least({CAP}, case when size > 0
              then ceil((target - b - size / 2) / source_size)
              when b < target then 1 else 0 end))::int as copies,
         row_number() over () as row
  from p),
e as (  -- one row per copy
  select *, least(1.0, (copy * source_size + b)::double / target) as share
  from c, range({CAP}) r(copy) where copy < copies),
g as (select *, case {cases} end as position from e),
o as (
  select *, row_number() over (order by round(position * 1e9)::bigint, doc_id nulls first, size, copy, row) - 1 as place
  from g)
select c.doc_id, c.size, c.source_size::bigint as source_size, round(c.target, 4) as target,
       c.copies::bigint * c.size as taken, round(x.position, 9) as position, {found}
from c left join (
  select row, max(case when copy = 0 then position end) as position, {each}
  from o group by row) x on c.row = x.row"""
