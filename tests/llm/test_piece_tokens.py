"""The agenda against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import sentencepiece

from cashtrail.llm import piece_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
HAND = [
    None, "", " ", "  ", "\n", "\n\n a", "a\n", " a", "a  b   c     ", "▁x ▁", "<s>", "</s> <unk> <0x41>", "\x00a\x00", "\U0001f600\U0001f1e9 é ü",
    "日本語テキスト", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, " " * 5000 + "y", "\t tab\r\n", "́a", "the quick brown fox", "   x", "()" * 999,
]


def expected(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for t in texts:
        ids = sp.encode(t or "")
        yield len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))


def test_ids_and_texts_equal_the_library(spark, sf_dir):
    draw = random.Random(3)
    parts = ["the", "ing", " ", "  ", "\n", "é", "日", "▁", "😀", "a", "Z", "0", "12", ".", ",", "<0x0A>", "\x7f", "ß", "tion", "́"]
    texts = HAND + ["".join(draw.choices(parts, k=draw.randint(1, 80))) for _ in range(500)]
    texts += [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = piece_tokens.digests(df, PATH)
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == dict(enumerate(expected(texts)))


def test_round_trip_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["decoded"], len(r["ids"])) for r in piece_tokens.encoded(df, PATH).collect())
    assert [o[:2] for o in out] == [(0, "a b"), (0, "a b"), (1, "")]
    assert piece_tokens.digests(df.filter("doc_id > 5"), PATH).count() == 0


def test_forgetting_parts_changes_nothing(monkeypatch):
    monkeypatch.setattr(piece_tokens, "KEPT_PARTS", 3)
    vocabulary = piece_tokens.Vocabulary(PATH)
    texts = [f"word{i % 7} and{i % 5} more{i}" for i in range(40)]
    for _ in range(2):
        for t in texts:
            (found,) = vocabulary.encode_batch([t])
            assert found == (vocabulary.library.encode(t), ",".join(map(str, vocabulary.library.encode(t))))


def test_both_agendas_agree():
    vocabulary, draw = piece_tokens.Vocabulary.of(PATH), random.Random(11)
    for length in (1, 2, 7, 20):
        parts = ["".join(draw.choices("abcdething▁▁日ß😀\x00é", k=length)) for _ in range(300)]
        assert vocabulary.merged_together(parts) == [vocabulary.merged(p) for p in parts]
