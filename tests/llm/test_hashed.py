"""Hashes of words and of runs of words."""

import random
import re

from cashtrail.llm import hashed


def test_equal_words_and_only_they_have_equal_hashes(monkeypatch):
    monkeypatch.setattr(hashed, "GROUP", 50)
    draw = random.Random(2)
    texts = [None, "", " ", "\n\na"] + ["".join(draw.choices("aAbé \n\t.,_1", k=draw.randint(0, 40))) for _ in range(300)] + ["z" * 70000, "y" * 70000]
    seen, back = {}, {}
    found = [x for x in hashed.word_hashes(texts, hashed.classes(False), lower=True)]
    counts = [n for _, c in found for n in c.tolist()]
    values = iter([int(h) for w, _ in found for h in w])
    for text, n in zip(texts, counts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").replace("A", "a"))
        assert len(words) == n
        for word in words:
            h = next(values)
            assert seen.setdefault(word, h) == h and back.setdefault(h, word) == word
    assert next(values, None) is None


def test_symbols_apart():
    ((words, counts),) = hashed.word_hashes(["ab%%cd ab %%"], hashed.classes(True))
    assert counts.tolist() == [5] and words[0] == words[3] and words[1] == words[4] and len(set(words.tolist())) == 3
