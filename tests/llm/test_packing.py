"""Packing: ids, gapless sequences, and the cuts against an exhaustive search."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cashtrail.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
HAND = [
    None, "", " ", "\n\n", "It's a Test.  Don't!", "É é é", "a b c", "日本 語。", "<|endoftext|> x<|startoftext|>y", "ΑΣ ΟΔΟΣ", "x" * 9000,
    "word " * 7000, "3.14 2,5 1e9 ...!!!", "<|ENDOFTEXT|>, a, B. <|endoftext|>.", "×, ÷. é, É. ñ., x÷, ß, ÿ. Ā, ﬁ. a's, 's, . , .,", "\U0001f600 z　w\x0bq\x0ct", "'s 're ll'd don'", "end. End! end? " * 3000, "İstanbul. ŒUVRE, ŒUVRE,, a., 1. é, É. ǅ. ŉ, ß. ẞ, K. Å,",
]


def cost_of(places, cost, chosen, length):
    total = 0
    for i, j in zip(chosen, chosen[1:]):
        size = int(places[j] - places[i])
        assert 0 < size <= length
        padding = 0 if size & (size - 1) == 0 else length - size
        total += packing.OPENING + padding + int(cost[j])
    return total


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_best(seed):
    draw = random.Random(seed)
    length = 64
    lengths = np.array([draw.randint(1, 90) for _ in range(12)])
    total = int(lengths.sum())
    inner = np.array(sorted(draw.sample(range(1, total), 20)))
    places, cost = packing.cut_places(lengths, inner, length)
    chosen = packing.best_cuts(places, cost, length)
    best = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        options = [best[i] + cost_of(places, cost, [i, j], length) for i in range(j) if best[i] is not None and places[j] - places[i] <= length]
        best[j] = min(options)
    assert cost_of(places, cost, chosen, length) == best[-1]


def check(rows, texts, length=packing.LENGTH):
    tokenizer = Tokenizer.from_file(PATH)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    padding = tokens = 0
    for found in sequences.values():
        at = 0
        for offset, size in sorted(found):
            assert offset == at and size > 0
            at += size
        assert at <= length
        tokens += at
        padding += 0 if at & (at - 1) == 0 else length - at
    for i, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return padding, tokens


def test_pieces_hold_the_tokenizers_ids(spark, sf_dir, monkeypatch):
    texts = HAND + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    padding, tokens = check(packing.packed(df.coalesce(1), PATH).collect(), texts)
    assert padding < 0.01 * tokens


def test_stretches_of_any_size(monkeypatch):
    draw = random.Random(1)
    stream, out, docs = packing._Stream(0, 32), [], {}
    for i in range(300):
        ids = np.array([draw.randint(0, 9) for _ in range(draw.randint(1, 120))], dtype=np.uint32)
        docs[i] = ids
        stream.add(i, ids, np.flatnonzero(ids == 3) + 1)
        if stream.waiting > 400:
            out += stream.flush(False)
            assert stream.waiting < 400
    out += stream.flush(True)
    for i, ids in docs.items():
        assert np.array_equal(np.concatenate([o[7] for o in out if o[0] == i]), ids)
    for s in range(stream.sequence):
        assert sum(o[2] for o in out if o[5] == s) <= 32


def test_repeated_rows_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, None)], "doc_id long, text string")
    rows = packing.packed(df.coalesce(1), PATH, with_ids=True).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in rows) == [(0, 2), (0, 2), (1, 1), (1, 1)]
    assert packing.packed(df.filter("doc_id = 4"), PATH).count() == 0


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_STEMS", 3)
    tokens = packing.WordTokens(PATH)
    texts = [f"Word{i % 7}, and. more{'x' * i}" for i in range(30)]
    for text, ids in zip(texts, tokens.batch(texts)):
        assert ids.tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids
    for text in texts:
        (ids,) = tokens.batch([text])
        assert ids.tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


def test_forgetting_stems_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_STEMS", 3)
    tokenizer, tokens = Tokenizer.from_file(PATH), packing.WordTokens(PATH)
    texts = [t or "" for t in HAND] + [f"word{i}, Wort{i % 7}é. {i}" for i in range(1500)]
    for at in range(0, len(texts), 400):
        some = texts[at : at + 400]
        for text, ids in zip(some, tokens.batch(some)):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(tokens.known) == len(tokens.rows) == len(tokens.sizes)
    assert (np.diff(tokens.known.astype(object)) > 0).all()


def test_a_tokenizer_that_sees_blanks_is_refused():
    with pytest.raises(ValueError):
        packing.WordTokens(public_tokenizers.path("byte_bpe_50k.json"))
