"""Preference pairs against a plain rendering."""

import random

from pyspark.sql import functions as F

from cashtrail.llm import preference as p


def render(turns):
    out, spans = "", []
    for role, text in turns:
        out += f"<|{role or 'none'}|>\n"
        start = len(out)
        out += (text or "").replace("<|", "< |") + "<|end|>\n"
        if role == "assistant":
            spans.append(f"{start}:{len(out)}")
    return out, ",".join(spans)


def brute(chosen, rejected):
    chosen, rejected = chosen or [], rejected or []
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    return (n, render(chosen[:n])[0], *render(chosen[n:]), *render(rejected[n:]))


def test_pairs_equal_a_plain_rendering(spark):
    draw = random.Random(6)
    turn = lambda: (draw.choice(["user", "assistant", "system", None]), draw.choice(["a", "é😀 b", "", None, "x<|end|>"]))
    pairs = [(None, None), ([], None), ([("user", "a")], [("user", "a")]), ([("user", "z" * 30000)], [("user", None)])]
    for _ in range(200):
        prefix = [turn() for _ in range(draw.randint(0, 4))]
        pairs.append((prefix + [turn() for _ in range(draw.randint(0, 3))], prefix + [turn() for _ in range(draw.randint(0, 3))]))
    rows = [(i, a, b, "clash") for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, f"pair_id int, chosen {p.TURNS}, rejected {p.TURNS}, prompt string")
    found = {r["pair_id"]: tuple(r)[1:] for r in p.formatted(df).collect()}
    assert found == {i: brute(a, b) for i, (a, b) in enumerate(pairs)}


def test_columns_named_like_working_ones_come_back_as_they_were(spark):
    df = spark.createDataFrame([(1, [("user", "a")], [("user", "b")])], f"pair_id int, chosen {p.TURNS}, rejected {p.TURNS}")
    names = ["_one", "_Other", "_prompt", "__one", "a.b"]
    row = p.formatted(df.withColumns({n: F.lit(f"own {n}") for n in names})).first()
    assert [row[n] for n in names] == [f"own {n}" for n in names]
    assert tuple(row)[-6:] == brute([("user", "a")], [("user", "b")])


def test_pairs_from_conversations(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "one"), (1, 2, "user", "r"), (1, 3, "assistant", "two"), (1, 4, "user", "end"),
        (2, 0, "user", "q"), (2, 1, "assistant", "only"), (3, 0, "user", "q"), (None, 0, "user", "lost"),
        (4, 0, "assistant", "same"), (4, 1, "assistant", "same"), (5, 0, None, None), (5, 0, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in p.formatted(p.stale_reply_pairs(df)).collect()}
    assert set(found) == {1, 2, 3, 4, 5}
    assert found[1]["n_prompt_turns"] == 3 and "two" in found[1]["chosen_text"] and "one" in found[1]["rejected_text"]
    assert found[2]["rejected_text"] == "" and found[2]["chosen_spans"] == "14:26"
    assert found[3]["n_prompt_turns"] == 1 and found[3]["chosen_text"] == ""
    assert found[4]["n_prompt_turns"] == 2 and found[5]["n_prompt_turns"] == 2
    assert p.stale_reply_pairs(df.filter("conv_id > 9")).count() == 0


def test_plan_has_no_python(spark, sf_dir):
    plan = p.op2_preference(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
