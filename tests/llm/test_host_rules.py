"""Measures against a plain count, and host verdicts."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from cashtrail.llm import host_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_measures_equal_a_plain_count(spark):
    draw = random.Random(4)
    texts = [None, "", " \n\t", "a b", "a b c", "a b c a b c", "x\x0by\x0cz\r", "é 😀 #", "w " * 30000, "l\n" * 100 + "l \nl", "|<>" * 50]
    for _ in range(150):
        words = draw.choices(["a", "b", "cc", "é", "#d", "e\n", "\x0b"], k=draw.randint(1, 120))
        texts.append(draw.choice([" ", "\n", "  "]).join(words))
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, N_words string")
    found = host_rules.measured(df).collect()
    columns = [*host_rules.MEASURES, "base_failed"]
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in found} == {i: brute(t) for i, t in enumerate(texts)}


def table(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good if i % 10 else bad, "fair") for i in range(60)]
    rows += [(100 + i, good if i < 3 else bad, "poor") for i in range(40)]
    rows += [(200, bad, None), (200, bad, None), (None, good, "fair"), (None, good, "fair"), (300, good, "tiny"), (301, bad, "small")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_host_verdicts(spark):
    out = host_rules.judged(table(spark)).collect()
    assert len(out) == 106
    kept = Counter((r["source"], r["kept"]) for r in out)
    assert kept[("fair", True)] == 56 and kept[("poor", True)] == 0 and kept[("tiny", True)] == 1
    rates = {r["source"]: r["host_rate"] for r in out}
    assert 0 < rates["tiny"] < rates["fair"] + 0.5 and rates["poor"] > 0.8 and 0.5 < rates["small"] < 1


def test_one_host_and_no_rows(spark):
    rows = table(spark).filter("source = 'fair'")
    assert {r["kept"] for r in host_rules.judged(rows).filter("not base_failed").collect()} == {True}
    assert host_rules.judged(rows.filter("doc_id < 0")).count() == 0


def test_columns_named_like_working_ones_come_back_as_they_were(spark):
    rows = table(spark).filter("doc_id is not null and doc_id <> 200")
    names = ["_words", "_lines", "_Windows", "_ordered", "_host", "__host", "a.b"]
    plain = {r["doc_id"]: r["kept"] for r in host_rules.judged(rows).collect()}
    found = host_rules.judged(rows.withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})).collect()
    assert {r["doc_id"]: r["kept"] for r in found} == plain
    assert all([r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names] for r in found)


def test_plan_is_native(spark):
    plan = host_rules.measured(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
