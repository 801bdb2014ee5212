"""The pipeline stage by stage against plain answers, and the SQL twins."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from brute import personal
from cashtrail.llm import host_rules, register
from cashtrail.llm.common import stored
from test_host_rules import brute as measures
from test_ngram_join import brute as groups
from test_packing import check

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """What every stage makes of the documents."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, sf_dir), "test-stage")
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES][:4] == ["quality_classifier", "quality_rules", "near_duplicates", "personal_data"]
    assert all(kept[n].columns == COLUMNS for n, _ in corpus_pipeline.STAGES[:4])
    assert all(kept[n].dtypes == kept["documents"].dtypes for n, _ in corpus_pipeline.STAGES[:4])


def test_classifier_drops_bad_documents(spark, sf_dir, kept):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, after = rows(kept["documents"]), rows(kept["quality_classifier"])
    assert all(after[i] == before[i] for i in after)
    good = [i for i, q in labels.items() if q and i in before]
    bad = [i for i, q in labels.items() if not q and i in before]
    assert sum(i in after for i in good) >= 0.95 * len(good) and sum(i in after for i in bad) <= 0.35 * len(bad)


def test_rules_drop_what_fails(kept):
    before, after = rows(kept["quality_classifier"]), rows(kept["quality_rules"])
    failed = {i: measures(r["text"])[-1] for i, r in before.items()}
    hosts = {r["source"] for r in host_rules.host_verdicts(host_rules.measured(kept["quality_classifier"]), "source").filter("not host_kept").withColumnRenamed("_host", "source").collect()}
    assert set(after) == {i for i, r in before.items() if not failed[i] and r["source"] not in hosts}


def test_one_document_of_each_group_stays(kept):
    before, after = rows(kept["quality_rules"]), rows(kept["near_duplicates"])
    ids = sorted(before)
    found = groups([before[i]["text"] for i in ids], 5, 80)
    assert set(after) == {ids[i] for i, (_, component) in found.items() if i == component}


def test_no_personal_data_stays(kept):
    before, after = rows(kept["near_duplicates"]), rows(kept["personal_data"])
    assert set(before) == set(after)
    for i, r in after.items():
        assert personal(r["text"])[:4] == (0, 0, 0, 0) and r["n_chars"] == len(r["text"])
        if personal(before[i]["text"])[:4] == (0, 0, 0, 0):
            assert r == before[i]


def test_packed_sequences_hold_all_documents(kept):
    texts = rows(kept["personal_data"])
    ids = sorted(texts)
    number = {d: i for i, d in enumerate(ids)}
    pieces = [dict(r.asDict(), doc_id=number[r["doc_id"]]) for r in kept["packing"].collect()]
    padding, tokens = check(pieces, [texts[d]["text"] for d in ids])
    assert padding < 0.05 * tokens


def test_run_equals_the_stages(spark, sf_dir, kept):
    one, other = corpus_pipeline.run(spark, sf_dir), kept["packing"]
    key = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert key(one) == key(other)


def test_repeated_and_null_ids(spark, sf_dir):
    text = " ".join(f"word{i}" for i in range(80))
    data = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text + " more", "en", "s", 1), (None, text, "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", None, 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in out) == {1: 1, None: 1, 3: 1, 4: 1}
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).collect()
        stage(spark, docs.filter("doc_id > 9"), sf_dir).collect()


@pytest.mark.parametrize("name", sorted(register.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = register.queries()[name](spark, sf_dir)
    columns = sorted(found.columns)
    mine = Counter(tuple(r[c] for c in columns) for r in found.collect())
    other = con.sql(register.oracle_sql()[name])
    place = [other.columns.index(c) for c in columns]
    assert sorted(other.columns) == columns
    assert mine == Counter(tuple(r[i] for i in place) for r in other.fetchall())


def test_rules_leave_columns_named_like_measures_alone(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text, "s", 7, "mine", "own") for i in range(3)] + [(9, "short", "s", 7, "mine", "own")],
                                 "doc_id long, text string, source string, n_words int, kept string, _row string")
    out = corpus_pipeline.quality_rules(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(i, text, "s", 7, "mine", "own") for i in range(3)]
