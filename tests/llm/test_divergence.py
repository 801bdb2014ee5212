"""Prices of sources against plain whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashtrail.llm import divergence

FIND = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, ranks=200):
    rows = [(t or "", x or "", s or "") for t, x, s in rows]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = FIND.findall(text.translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    kept = {lang: [t for t, n in found.items() if n >= 3] for lang, found in docs.items()}
    out = []

    def priced(lang, found):
        n, v = sum(found[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (found[t] + 1) // (n + v) for t in kept[lang]}

    groups = {(x, s) for _, x, s in rows}
    p = {g: priced(g[0], counts[g]) for g in groups}
    for lang in kept:
        p[lang] = priced(lang, sum((counts[g] for g in groups if g[0] == lang), Counter()))
    for lang, source in groups:
        own = p[lang, source]

        def ranked(part, found, limit=None):
            found.sort(key=lambda f: (-f[0], f[1].encode()))
            return [(lang, source, part, item, value, r + 1) for r, (value, item) in enumerate(found[:limit])]

        others = [s for x, s in groups if x == lang and s != source]
        out += ranked("pair", [(sum((own[t] - p[lang, s][t]) ** 2 // p[lang, s][t] for t in own), s) for s in others])
        q = p[lang]
        out += ranked("term", [((own[t] - q[t]) ** 2 // q[t], t) for t in own if counts[lang, source][t] and own[t] > q[t]], ranks)
    return sorted(out)


def ask(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("n", F.lit("clash")).withColumn("term", F.lit(1))
    return sorted(tuple(r) for r in divergence.audit(df, **kw).collect())


def corpus(seed, docs=160, words=90, sources=11):
    draw = random.Random(seed)
    lexicon = ["".join(draw.choice("abcdéßя漢") for _ in range(draw.randint(1, 4))) for _ in range(words)]
    out = []
    for _ in range(docs):
        source = min(draw.randrange(sources), draw.randrange(sources))
        some = [w.upper() if draw.random() < 0.1 else w for w in draw.choices(lexicon[source * 3 :], k=draw.randint(0, 30))]
        out.append((draw.choice([" ", "-", "\x00", "1"]).join(some), draw.choice(["en", "de"]), f"s{source}"))
    return out


@pytest.mark.parametrize("slice_,held,tile", [(1 << 18, 250_000, 8), (40, 30, 2)])
def test_equal_to_plain_numbers(spark, monkeypatch, slice_, held, tile):
    monkeypatch.setattr(divergence, "SLICE", slice_)
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = corpus(1)
    assert ask(spark, rows, ranks=5) == brute(rows, 5)


def test_nulls_empty_texts_and_repeats(spark):
    rows = [(None, None, None), ("", "en", "a"), ("1 2", "en", "b"), ("word", "xx", "only"), ("É é Ab aB", None, "c")] + [("Same same words", "en", "c")] * 4
    rows += [("É AB", "", "d")] * 3 + [("lone", "fr", "a"), ("lone", "fr", "b")] + [("x " * 60_000, "en", "a")]
    assert ask(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert ask(spark, []) == []


def test_gallop_finds_what_is_there():
    draw = np.random.default_rng(3)
    for size in (0, 1, 5, 400, 4000):
        long = np.sort(draw.choice(5000, size, replace=False)).astype(np.int32)
        short = np.sort(draw.choice(5000, 60, replace=False)).astype(np.int32)
        at, there = divergence.gallop(short, long)
        assert there.tolist() == np.isin(short, long).tolist()
        assert (long[at[there]] == short[there]).all()


def test_shares_are_exact():
    counts = [0, 7, 10**12, 8 * 10**15]
    total, terms = 9 * 10**15, 12345
    assert divergence.shares(np.array(counts), total, terms).tolist() == [1 + 10**9 * (c + 1) // (total + terms) for c in counts]
