"""Preference formatting against a plain version, and the plan's purity."""

from pyspark.sql import functions as F

from liftlab.llm import preference

SF = "/root/testdata/sf0.01"


def render(role, text):
    return f"<|{role or ''}|>\n{text or ''}<|end|>\n"


def plain(rows):
    convs = {}
    for c, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        if c is not None:
            convs.setdefault(c, []).append((role, text))
    groups = {}
    for c in sorted(convs):
        role, text = convs[c][0]
        groups.setdefault((role or "", text or ""), []).append(c)
    out = {}
    for ids in groups.values():
        for a, b in zip(ids, [*ids[1:], None]):
            if b is None:
                out[a] = (None, len(convs[a]), None, None)
                continue
            x, y = convs[a], convs[b]
            k = 0
            while k < min(len(x), len(y)) and x[k] == y[k]:
                k += 1
            out[a] = (b, len(x), len(y), k, "".join(render(*t) for t in x[:k]),
                      *("".join(render(*t) for t in s[k:]) for s in (x, y)),
                      *(",".join(f"{len(render(*t))}:{int(t[0] == 'assistant')}" for t in s[k:]) for s in (x, y)))
    return out


def collected(df):
    return {r["chosen_id"]: (r["rejected_id"], len(r["chosen"]), r["rejected"] and len(r["rejected"]), r["common_turns"],
                             *((r["prompt"], *("".join(t["text"] for t in r[s]) for s in SIDES),
                                *(",".join(f"{t['chars']}:{int(t['trained'])}" for t in r[s]) for s in SIDES))
                               if r["rejected"] is not None else ()))
            for r in df.where("chosen_id is not null").collect()}


SIDES = ("chosen_completion", "rejected_completion")


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    extra = [(c + 10_000, t, r, x if t < 2 else x + "!") for c, t, r, x in rows if c % 3 == 0]
    turns = spark.createDataFrame(rows + extra, "conv_id long, turn long, role string, text string")
    got = collected(preference.format_pairs(preference.pair_by_first_turn(preference.conversations(turns))))
    want = plain(rows + extra)
    assert got == want
    assert any(len(w) > 4 and w[3] == 2 and w[5] for w in want.values())


def test_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (2, 0, "user", "hi"), (2, 1, "assistant", "a"),
            (2, 2, "user", None), (3, 0, "user", "hi"), (3, 1, "assistant", "b"), (4, None, None, None),
            (5, 0, None, ""), (5, 0, None, ""), (6, 0, "", None), (None, 0, "user", "hi"), (None, 1, None, "x"),
            (7, 0, "user", "w " * 200_000), (8, 0, "user", "w " * 200_000), (8, 1, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {"chosen": F.lit("clash"), "prompt": F.lit(1), "turns": F.lit(2), "number": F.lit(3)})
    pairs = preference.pair_by_first_turn(preference.conversations(turns))
    formatted = preference.format_pairs(pairs)
    got = collected(formatted)
    assert got == plain(rows)
    assert got[1][:4] == (2, 2, 3, 2) and got[1][5] == "" and got[2][0] == 3
    lone = formatted.where("chosen_id is null").collect()
    assert sorted((r["chosen"][0]["role"] or "", r["chosen"][0]["text"]) for r in lone) == [("", "x"), ("user", "hi")]
    assert all(len(r["chosen"]) == 1 and r["rejected"] is None and r["common_turns"] is None for r in lone)


def test_turns_without_a_conversation_are_not_gathered(spark):
    """A third of all turns have no conv_id: one row each, and no group or partition holds them all."""
    rows = [(None if i % 3 == 0 else i // 6, i, "user", f"t{i % 5}") for i in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    convs = preference.conversations(turns)
    assert convs.where("conv_id is null").count() == 1000
    assert convs.agg(F.max(F.size("turns"))).first()[0] == 4
    pairs = preference.pair_by_first_turn(convs)
    assert pairs.where("chosen_id is null and rejected is null").count() == 1000
    sizes = [len(p) for p in convs.where("conv_id is null").rdd.glom().collect()]
    assert max(sizes) < 400


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.format_pairs(preference.pair_by_first_turn(preference.conversations(turns))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = preference.query(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
