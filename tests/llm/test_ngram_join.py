"""The n-gram join against comparing every pair."""

import random
import re

import pytest

from cashtrail.llm import graph, ngram_join


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(texts, size, percent):
    sets = [shingles(t, size) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                inter = len(sets[i] & sets[j])
                if 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def corpus(seed, n=160):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdeé", k=3))
    passage = [word() for _ in range(30)]
    texts = [None, "", " \n", "One", "one", "a b", "A B", "a b c", "a b c d", "x " * 300, "x " * 400]
    bases = [[word() for _ in range(draw.randint(3, 120))] for _ in range(12)]
    while len(texts) < n:
        words = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 6])):
            words[draw.randrange(len(words))] = word()
        if draw.random() < 0.3:
            at = draw.randrange(len(words))
            words[at:at] = passage
        if draw.random() < 0.2:
            words += [word() for _ in range(draw.randint(1, 9))]
        texts.append(draw.choice([" ", "\n", "\t "]).join(words))
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("size,percent,seed", [(3, 90, 1), (5, 80, 2), (3, 90, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, size, percent, seed):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)  # several tiles for each group
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(df, size, percent).collect()}
    assert found == brute(texts, size, percent)


def test_frequent_passages_and_whole_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", (5, 0))
    texts = corpus(7, 120)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(df, 5, 80).collect()}
    assert found == brute(texts, 5, 80)


def test_null_and_repeated_ids(spark):
    same = "one two three four five six"
    df = spark.createDataFrame([(None, same), (4, same), (4, same), (7, same), (9, None), (None, None)], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.linked(df, 3, 90).collect())
    assert [r for r in rows if r[0]] == [(4, 4, 4), (4, 4, 4), (7, 4, 4), (9, 0, 9)]
    assert {r for r in rows if not r[0]} == {(0, 4, None), (0, 0, None)}
    assert ngram_join.linked(df.filter("doc_id = 1"), 3, 90).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 299)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = dict(tuple(r) for r in graph.components(df).collect())
    assert found == {i: 0 for i in range(61)} | {k: 100 for k in range(100, 140)} | {299: 299, 300: 299}
