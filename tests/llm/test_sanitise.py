"""Personal data against a plain scan, and the terms that reveal it."""

import random

from brute import personal
from cashtrail.llm import sanitise, spans
from pyspark.sql import functions as F

HAND = [
    None, "", "plain words", "a.b@c.d", "a@b", "x@y.z_q@w.org", "a@b.com_x@y.org", "@@ a@-.- .a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.000.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 2", "0000000000000000000", "+1 (017) 555-7713", "+1(((", "+12345678", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é\U0001f600 a@b.co 10.0.0.1",
    "z" * 20000 + "@x.org", "1" * 30000, "4111111111111111" + " " * 2 + "4111111111111111",
]


def table(spark, texts):
    return spark.createDataFrame([(i, t, len(t or ""), "k") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, base string")


def test_base_spans_equal_a_plain_scan(spark):
    draw = random.Random(9)
    parts = ["a", "B.", "@", "x.org", "1", "23", "255", ".", "256", "+", " ", "-", "(", ")", "4111", "1111", "0000", "é", "😀", "%", "_", "\n"]
    texts = HAND + ["".join(draw.choices(parts, k=draw.randint(1, 50))) for _ in range(500)]
    size = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k))
    out = sanitise.scanned(table(spark, texts)).select("_id", size("email"), size("ip"), size("card"), size("phone"), F.sha2(spans.joined(F.col("base")), 256))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == {i: personal(t) for i, t in enumerate(texts)}


def test_terms_that_reveal_an_entity(spark):
    mail = "kim@corp.example.org"
    texts = [f"note {i} from Zanzibarite at {mail} about the common thing {i}" for i in range(4)]
    texts += [f"the common thing from about note row {i}" for i in range(400)]
    out = sanitise.cleaned(table(spark, texts)).orderBy("doc_id").collect()
    assert out[0]["text"] == "note 0 from  at <EMAIL> about the common thing 0"
    assert out[0]["n_chars"] == len(out[0]["text"])
    assert [r["text"] for r in out[4:]] == texts[4:]
    assert {r["base"] for r in out} == {"k"}


def test_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a@b.org"), (None, "a@b.org"), (1, None), (1, ""), (1, "c@d.org x")], "doc_id long, text string")
    out = sanitise.cleaned(df, length=None).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "-") for r in out) == [(0, "<EMAIL>"), (0, "<EMAIL>"), (1, "-"), (1, "-"), (1, "<EMAIL> x")]
    assert sanitise.scanned(df).count() == 5
    assert sanitise.scanned(df.filter("doc_id > 9")).count() == 0


def test_terms_far_off_short_terms_and_texts_without_the_entity(spark):
    far = " ".join(f"filler{k}" for k in range(60))
    texts = [f"Li, {far} row {i} of account K-4711 {far} Zanzibarite, mail kim@corp.example.org" for i in range(4)]
    texts += ["with Zanzibarite alone and Li, Kim too"]
    texts += [f"the {far} row of account {i}" for i in range(800)]
    out = [r["text"] for r in sanitise.cleaned(table(spark, texts)).orderBy("doc_id").collect()]
    assert out[0] == f"Xx, {far} row 0 of account  {far} Xx, mail <EMAIL>".replace(" mail", " ")
    assert out[4] == "with Xx alone and Xx, Kim too"
    assert out[5:] == texts[5:]


def test_repeated_rows_count_alike_in_every_figure(spark):
    texts = [f"row {i} Zanzibarite kim@corp.example.org" for i in range(2)]
    rows = [(i % 2, texts[i % 2]) for i in range(8)] + [(None, "row 2 Zanzibarite kim@corp.example.org")] * 4
    rows += [(100 + i, f"row {i}") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    (found,) = sanitise.disclosing_terms(sanitise.found_spans(docs)).collect()
    assert tuple(found) == ("zanzibarite", 1.0)
    out = sanitise.cleaned(docs, length=None).filter("doc_id < 2 or doc_id is null").collect()
    assert len(out) == 12 and not any("Zanz" in r["text"] for r in out)


def test_columns_named_like_working_ones_come_back_as_they_were(spark):
    names = ["_id", "_hash", "_base", "_spans", "_new", "added", "base", "_row", "terms", "names", "shares", "_t", "_found", "a.b", "n_chars_2"]
    df = spark.createDataFrame([(1, "write to kim0@corp.org now", 26), (2, "nothing here", 12), (3, None, None)], "doc_id long, text string, n_chars long")
    docs = df.withColumns({n: F.concat(F.lit(f"own {n} "), F.col("doc_id").cast("string")) for n in names})
    out = sanitise.cleaned(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r.asDict() for r in out.collect()}
    for doc_id, row in rows.items():
        assert [row[n] for n in names] == [f"own {n} {doc_id}" for n in names]
    assert rows[1]["text"] == "write to <EMAIL> now" and rows[1]["n_chars"] == 20
    assert rows[2]["text"] == "nothing here" and rows[3]["text"] is None and rows[3]["n_chars"] is None
