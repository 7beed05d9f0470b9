"""Preference formatting: pairs of conversations as one prompt and two masked completions.

The longest common prefix of turns (equal role and text) of a chosen and a
rejected conversation is rendered once, as the prompt. What follows it in
either conversation is rendered as that side's completion, with a mask that says
which characters are trained on: those of turns by TRAINED_ROLE. Only DataFrame
functions are used.

Defined cases. Turns are ordered by (turn, role, text); repeated turns stay.
A null role or text compares equal to null and renders as empty. A turn without
a conv_id is a conversation of its own, without an id and without a partner (however many there are, none
are gathered). If one conversation is a prefix
of the other, its completion is empty. A conversation without a partner keeps
null in the columns of the pair. An empty table gives an empty result. Further columns are
ignored. A conversation is one training example, so it must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlab.llm.common import ranked, stored, table

TRAINED_ROLE = "assistant"


def render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"),
                    F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>\n"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, turns); a turn without a conv_id is one by itself."""
    one = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    turns = turns.select("conv_id", "turn", "role", "text")
    lone = turns.where(F.col("conv_id").isNull()).select("conv_id", F.array(F.struct("role", "text")).alias("turns"))
    return turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(
        F.transform(one, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    ).unionByName(lone)


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(a, 1, shorter), lambda t, i: t.eqNullSafe(F.get(b, i)))
    first = F.array_position(same, False)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.when(first == 0, shorter).otherwise(first - 1)).cast("int")


def completion(turns: Column, common: Column) -> Column:
    """Rendered turns after the prompt, each with its length and whether it is trained."""
    rest = F.slice(turns, common + 1, F.size(turns))
    return F.transform(rest, lambda t: F.struct(
        render(t).alias("text"), F.length(render(t)).alias("chars"),
        F.coalesce(t["role"] == TRAINED_ROLE, F.lit(False)).alias("trained")))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(chosen, rejected: arrays of turns) plus common_turns, prompt and both completions."""
    p = pairs.withColumn("common_turns", common_turns(F.col("chosen"), F.col("rejected")))
    shared = F.slice("chosen", F.lit(1), F.col("common_turns"))
    return p.withColumns({
        "prompt": F.array_join(F.transform(shared, render), ""),
        "chosen_completion": completion(F.col("chosen"), F.col("common_turns")),
        "rejected_completion": completion(F.col("rejected"), F.col("common_turns"))})


def pair_by_first_turn(convs: DataFrame) -> DataFrame:
    """Each conversation with the next one (by conv_id) that opens with the same turn.

    Conversations are numbered by a distributed sort on (opening, conv_id) and
    joined with their successor's number, so an opening shared by very many of them
    is not gathered in one place.
    """
    first = F.get("turns", F.lit(0))
    key = F.md5(F.concat(F.coalesce(first["role"], F.lit("")), F.lit("\n"),
                         F.coalesce(first["text"], F.lit(""))).cast("binary"))
    convs = stored(convs.withColumn("opening", key), "chat-conversations")
    lone = convs.where(F.col("conv_id").isNull()).select(
        F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), F.col("turns").alias("chosen"),
        F.when(F.lit(False), F.col("turns")).alias("rejected"))
    convs = convs.where(F.col("conv_id").isNotNull())
    order = ranked(convs.select("opening", "conv_id"), ["opening", "conv_id"], "chat-order", "number")
    mine = order.select("opening", F.col("conv_id").alias("chosen_id"), "number")
    after = order.select(F.col("opening").alias("_opening"), F.col("conv_id").alias("rejected_id"),
                         (F.col("number") - 1).alias("_number"))
    pairs = mine.join(after, (mine["number"] == after["_number"]) & (mine["opening"] == after["_opening"]), "left")
    one = convs.select(F.col("conv_id").alias("_id"), F.col("turns").alias("chosen"))
    two = convs.select(F.col("conv_id").alias("_id"), F.col("turns").alias("rejected"))
    pairs = pairs.join(one, pairs["chosen_id"] == one["_id"]).drop("_id")
    return pairs.join(two, pairs["rejected_id"] == two["_id"], "left").select(
        "chosen_id", "rejected_id", "chosen", "rejected").unionByName(lone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = format_pairs(pair_by_first_turn(conversations(table(spark, sf_dir, "conversations"))))

    def text(side: str) -> Column:
        return F.array_join(F.transform(side, lambda t: t["text"]), "")

    def mask(side: str) -> Column:
        return F.array_join(F.transform(side, lambda t: F.concat_ws(
            ":", t["chars"].cast("string"), F.when(t["trained"], "1").otherwise("0"))), ",")

    return p.select(
        "chosen_id", "rejected_id", F.size("chosen").cast("long").alias("chosen_turns"),
        F.when(F.col("rejected").isNotNull(), F.size("rejected")).cast("long").alias("rejected_turns"),
        F.col("common_turns").cast("long").alias("common_turns"), "prompt",
        text("chosen_completion").alias("chosen_completion"), mask("chosen_completion").alias("chosen_mask"),
        text("rejected_completion").alias("rejected_completion"),
        mask("rejected_completion").alias("rejected_mask"))


def oracle() -> str:
    """DuckDB: one row per turn, a window for the successor, and joins turn by turn."""
    return f"""
with named as (  -- a turn without a conv_id is a conversation of its own
  select *, case when conv_id is null then 'n' || row_number() over () else 'c' || conv_id end as k
  from conversations),
t as (
  select k as conv_id, conv_id as id, role, text,
         row_number() over (partition by k order by turn, role, text) as i,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) as r,
         case when role = '{TRAINED_ROLE}' then '1' else '0' end as m
  from named),
c as (
  select conv_id, id, count(*) as n,
         max(case when i = 1 then md5(coalesce(role, '') || chr(10) || coalesce(text, '')) end) as o
  from t group by conv_id, id),
p as (
  select conv_id as a, id as ida, n as na, lead(conv_id) over w as b, lead(id) over w as idb, lead(n) over w as nb
  from c window w as (partition by o, case when id is null then conv_id end order by id)),
d as (  -- first turn that differs
  select a, coalesce(min(case when x.role is distinct from y.role or x.text is distinct from y.text
                              then x.i - 1 end), min(least(na, nb))) as k
  from p join t x on x.conv_id = a join t y on y.conv_id = b and y.i = x.i
  group by a),
q as (select p.*, d.k from p left join d using (a)),
s as (
  select q.a,
         string_agg(case when i <= k then r end, '' order by i) as prompt,
         string_agg(case when i > k then r end, '' order by i) as done,
         string_agg(case when i > k then length(r) || ':' || m end, ',' order by i) as mask
  from q join t on conv_id = a group by q.a),
z as (
  select q.a,
         string_agg(case when i > k then r end, '' order by i) as done,
         string_agg(case when i > k then length(r) || ':' || m end, ',' order by i) as mask
  from q join t on conv_id = b group by q.a)
select q.ida as chosen_id, q.idb as rejected_id, na::bigint as chosen_turns, nb::bigint as rejected_turns,
       k::bigint as common_turns, case when b is not null then coalesce(s.prompt, '') end as prompt,
       case when b is not null then coalesce(s.done, '') end as chosen_completion,
       case when b is not null then coalesce(s.mask, '') end as chosen_mask,
       case when b is not null then coalesce(z.done, '') end as rejected_completion,
       case when b is not null then coalesce(z.mask, '') end as rejected_mask
from q join s using (a) left join z using (a)"""
