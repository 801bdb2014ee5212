"""From documents to packed training sequences, in five stages.

Every stage takes all that its predecessor kept; what it decides takes effect. Between
stages the rows are written as Parquet to the shared folder and read again. All but the
last return the columns of the documents, in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail.llm import host_rules, ngram_join, packing, quality_model, sanitise
from cashtrail.llm.common import free_names, own_columns, small_side, stored

TOKENIZER = "word_bpe_49k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    (score,) = free_names(docs, "_score")
    out = quality_model.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score=score)
    return out.filter(F.col(score) >= 0.5).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host is rejected, go; the others keep every column as it was."""
    rows = docs.select("text", "source", own_columns(docs).alias("_row"))
    return host_rules.judged(rows).filter("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Rows that repeat an id are one document, of which one row stays. Rows without an
    id link with nothing and stay.
    """
    groups = stored(ngram_join.linked(docs, size=5, percent=80).select("doc_id", "component_id"), "groups")
    others = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(small_side(others), "doc_id", "left_anti").select(*docs.columns)
    repeated = stored(groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced, terms that reveal it are generalised or removed."""
    return sanitise.cleaned(docs).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed_sequences),
]

ORACLE_SQL = None  # a trained network and a tokenizer are no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
