"""Held-out accuracy, the vectors against a plain count, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from cashtrail.llm import quality_model as model
from cashtrail.llm.hashed import classes, word_hashes


def test_word_table_equals_a_plain_count(spark):
    texts = ["a b c a", None, "", "b, b c", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    index, expected = model.index_vectors().astype(int), np.zeros((model.BUCKETS, model.DIMENSIONS), dtype=int)
    for text in texts:
        for words, _ in word_hashes([text], classes(True)):
            buckets = (words % np.uint64(model.BUCKETS)).astype(int).tolist()
            for i, word in enumerate(buckets):
                for j in range(max(0, i - model.REACH), min(len(buckets), i + model.REACH + 1)):
                    if j != i:
                        expected[word] += index[buckets[j]]
    assert np.array_equal(model.word_table(df), expected)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = model.op3_quality_model(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_labels_of_held_out_documents_are_never_used(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r["doc_id"]: r["score"] for r in model.scored(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, "a b", "x"), (1, None, "x"), (1, None, "x"), (2, "", "y"), (3, "good words here " * 9000, None)], "doc_id long, text string, score string"
    )
    labels = spark.createDataFrame([(2, None), (2, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    rows = model.scored(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert model.scored(docs, labels.filter("doc_id > 7")).filter("score = 0.5").count() == 5
    assert model.scored(docs.filter("doc_id > 7"), labels).count() == 0
