"""I-Match against the same fingerprints made in plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from cashtrail.llm import imatch

FIND = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def of_text(text, seed=42):
    return signed(xxhash.xxh64_intdigest(text.encode(), seed))


def of_numbers(numbers):
    seed = 42
    for n in numbers:
        seed = xxhash.xxh64_intdigest((n & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed & 0xFFFFFFFF


def brute(rows, rare=imatch.RARE, common=imatch.COMMON):
    texts = [t or "" for _, t in rows]
    found = Counter(w for t in texts for w in set(FIND.findall(t.translate(LOWER))))
    low, high = max(2, math.ceil(rare * len(rows))), max(2, math.floor(common * len(rows)))
    lexicon = {w for w, n in found.items() if low <= n <= high}

    def marks(text):
        own = sorted(of_text(w) for w in set(FIND.findall(text.translate(LOWER))) & lexicon)
        out = [of_numbers(own) if own else of_numbers([signed(xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(b"text", 42)))])]
        subsets = [own] * imatch.FAMILIES
        for level in range(imatch.LEVELS):
            subsets = [[n for n in s if not n >> (imatch.LEVELS * f + level) & 1] for f, s in enumerate(subsets)]
            out += [of_numbers(s) if s else None for s in subsets]
        return out

    def near(a, b):
        both = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
        return sum(x == y for x, y in both) / len(both)

    def shown(m):
        return ".".join("" if x is None else f"{x:x}" for x in m)

    order = sorted(range(len(rows)), key=lambda i: ((1 << 63) - 1 if rows[i][0] is None else rows[i][0], of_text(texts[i]), texts[i]))
    out = []
    for i, j in zip(order, order[1:] + order[:1]):
        text, half = texts[i], len(texts[i]) // 2
        edited = text[: len(text) - half] + texts[j][:half]
        a, e, b = marks(text), marks(edited), marks(texts[j])
        out.append((rows[i][0], len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(e), near(a, e), near(a, b)))
    return sorted(out, key=repr)


def ask(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("marks", F.lit(1)).repartition(5)
    return sorted((tuple(r) for r in imatch.fingerprints(df, **kw).collect()), key=repr)


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(300)]
    return [(draw.randrange(10**6) * 3 - 10**6, " ".join(draw.choices(words, k=draw.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("seed,n,rare,common", [(1, 150, 0.001, 0.1), (2, 77, 0.05, 0.5)])
def test_equal_to_plain_python(spark, seed, n, rare, common):
    rows = corpus(seed, n)
    assert ask(spark, rows, rare=rare, common=common) == brute(rows, rare, common)


def test_nulls_ties_and_repeats(spark):
    rows = corpus(3, 40) + [(None, "no id one two"), (None, None), (None, "no id three"), (5, None), (6, ""), (7, "x")]
    rows += [(11, f"copies of an id {i % 9}") for i in range(30)] + [(12, "the same row"), (12, "the same row"), (13, "the same row")]
    got = ask(spark, rows)
    assert got == brute(rows)
    same = {r[3] for r in got if r[0] in (12, 13)}
    assert len(same) == 1


def test_one_row_is_its_own_successor_and_none_gives_none(spark):
    assert ask(spark, [(1, "abcd é")]) == brute([(1, "abcd é")])
    assert ask(spark, []) == []


def test_a_very_long_text(spark):
    rows = [(1, "alpha beta " * 40_000), (2, "alpha gamma"), (3, "beta gamma " * 3)]
    assert ask(spark, rows) == brute(rows)


def test_edits_stay_nearer_than_other_documents(spark):
    got = ask(spark, corpus(4, 200))
    assert sum(r[5] for r in got) > 5 * sum(r[6] for r in got)


def test_no_python_on_the_executors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    plan = imatch.fingerprints(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
