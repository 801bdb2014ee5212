"""Quality classifier: random indexing, pooled word vectors, a two-layer network.

Every word has a sparse random index vector, made from its hash. A word's vector is
the sum of the index vectors of its neighbours over all documents; words share a
table of ``BUCKETS`` rows by hash, so the table has a fixed size. A document is the
mean and the spread of the vectors of its words and the mean product of neighbours
(which shows repeated words). A network with one hidden layer learns from labelled
documents; a temperature, fitted on labelled documents the network has not seen,
makes its output a probability.

The word vectors cover all documents. The network learns from at most ``SAMPLE``
labelled documents, those with the smallest hash of the id; held-out ids (remainder
1) are never among them. Id, label, language and source are never inputs.

A null or empty text has no words: its features are zeros and it gets a score. A row
with a null id is scored and counts as not held out. Labels that are null are left
out, repeated labels of an id are averaged. Without labels of both kinds the score is
the share of good labels (0.5 without any). Repeated rows are scored each by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from cashtrail.llm.common import documents, remainder, small_batches, tidy
from cashtrail.llm.hashed import classes, word_hashes
from cashtrail.llm.tables import added_up

BUCKETS = 1 << 15
DIMENSIONS = 32
NONZERO = 6  # entries of an index vector
REACH = 2  # neighbours on each side
SAMPLE = 20_000
HIDDEN = 32
ROUNDS = 60
FEATURES = 3 * DIMENSIONS + 1
FEW_WORDS = 8
FOLDS, HELD_OUT = 3, 1

def index_vectors() -> np.ndarray:
    """One sparse vector of -1 and 1 for each bucket, the same everywhere."""
    draw = np.random.default_rng(20)
    out = np.zeros((BUCKETS, DIMENSIONS), dtype=np.int8)
    places = draw.random((BUCKETS, DIMENSIONS)).argsort(axis=1)[:, :NONZERO]
    out[np.arange(BUCKETS)[:, None], places] = draw.choice([-1, 1], size=places.shape)
    return out


def _buckets(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the words of a run of texts, and the number of words of each."""
    for words, sizes in word_hashes(texts, classes(symbols_apart=True)):
        yield (words % np.uint64(BUCKETS)).astype(np.int32), sizes


def word_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Sums of the neighbours' index vectors for each bucket, over all documents."""

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        index = index_vectors()
        table = np.zeros((DIMENSIONS, BUCKETS))
        for batch in batches:
            for words, sizes in _buckets(batch.column(0).to_pylist()):
                owner = np.repeat(np.arange(len(sizes)), sizes)
                around = np.zeros((len(words), DIMENSIONS), dtype=np.int8)
                for step in range(1, REACH + 1):
                    same = (owner[step:] == owner[:-step])[:, None]
                    around[step:] += index[words[:-step]] * same
                    around[:-step] += index[words[step:]] * same
                for d in range(DIMENSIONS):
                    table[d] += np.bincount(words, weights=around[:, d], minlength=BUCKETS)
        return table.T.reshape(-1).astype(np.int64)

    return added_up(docs.select(text), fill, BUCKETS * DIMENSIONS).reshape(BUCKETS, DIMENSIONS)


def word_vectors(table: np.ndarray) -> np.ndarray:
    """Unit vectors; an unseen bucket stays zero."""
    size = np.linalg.norm(table, axis=1, keepdims=True)
    return np.divide(table, size, out=np.zeros(table.shape), where=size > 0).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """For each text the mean and spread of its word vectors, the mean product of
    neighbouring ones, and the number of words."""
    out = [np.zeros((0, FEATURES))]
    for words, sizes in _buckets(texts):
        features = np.zeros((len(sizes), FEATURES))
        full = np.flatnonzero(sizes)
        if len(full):
            n = sizes[full, None]
            starts = (np.cumsum(sizes) - sizes)[full]
            own = vectors[words]
            mean = np.add.reduceat(own, starts, axis=0, dtype=np.float64) / n
            square = np.add.reduceat(own * own, starts, axis=0, dtype=np.float64) / n
            beside = own.copy()
            beside[1:] *= own[:-1]
            beside[starts] = 0  # a first word has none before it
            beside = np.add.reduceat(beside, starts, axis=0, dtype=np.float64) / n
            features[full] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), beside, n])
        out.append(features)
    return np.vstack(out)


class Network:
    """Inputs, one hidden layer, one output; trained with Adam on the log loss."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: list[np.ndarray], temperature: float):
        self.centre, self.scale, self.weights, self.temperature = centre, scale, weights, temperature

    def inputs(self, features: np.ndarray) -> np.ndarray:
        """Centred and scaled; the fewer words, the closer to the centre."""
        n = features[:, -1:]
        return (features[:, :-1] - self.centre) / self.scale * n / (n + FEW_WORDS)

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        hidden = np.tanh(self.inputs(features) @ w1 + b1)
        return hidden @ w2 + b2

    def scores(self, features: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(features) / self.temperature)

    @classmethod
    def trained(cls, features: np.ndarray, labels: np.ndarray) -> Network:
        draw = np.random.default_rng(8)
        n = features.shape[1] - 1
        weights = [draw.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        if len(set(labels.tolist())) < 2:
            share = float(labels.mean()) if len(labels) else 0.5
            constant = [np.zeros((n, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log((share + 1e-3) / (1 - share + 1e-3))])]
            return cls(np.zeros(n), np.ones(n), constant, 1.0)
        unseen = np.arange(len(labels)) % 5 == 0  # for the temperature
        centre, scale = features[:, :-1].mean(axis=0), features[:, :-1].std(axis=0) + 1e-3
        network = cls(centre, scale, weights, 1.0)
        x, y = network.inputs(features[~unseen]), labels[~unseen]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(ROUNDS):
            order = draw.permutation(len(y))
            for at in range(0, len(y), 128):
                rows = order[at : at + 128]
                w1, b1, w2, b2 = weights
                hidden = np.tanh(x[rows] @ w1 + b1)
                error = (_sigmoid(hidden @ w2 + b2) - y[rows]) / len(rows)
                inner = np.outer(error, w2) * (1 - hidden * hidden)
                slopes = [x[rows].T @ inner + 1e-4 * w1, inner.sum(axis=0), hidden.T @ error + 1e-4 * w2, error.sum(keepdims=True)]
                step += 1
                for i, slope in enumerate(slopes):
                    first[i] = 0.9 * first[i] + 0.1 * slope
                    second[i] = 0.999 * second[i] + 0.001 * slope * slope
                    weights[i] = weights[i] - 0.005 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        network.weights = weights
        logits, y = network.logits(features[unseen]), labels[unseen]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        losses = [-np.mean(np.log(np.clip(np.where(y > 0.5, _sigmoid(logits / t), 1 - _sigmoid(logits / t)), 1e-12, 1))) for t in grid]
        network.temperature = float(grid[int(np.argmin(losses))]) if len(y) else 1.0
        return network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fitted(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and the network."""
    spark = docs.sparkSession
    vectors = word_vectors(word_table(docs, text))
    shared = spark.sparkContext.broadcast(vectors)  # BUCKETS x DIMENSIONS numbers
    allowed = labels.filter(F.col(label).isNotNull() & (remainder(F.col(id_column), FOLDS) != HELD_OUT))
    chosen = allowed.groupBy(F.col(id_column).alias("_id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pooled(batch.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(found), pa.list_(pa.float64()))], ["id", "label", "features"])

    found = rows.select(F.col("_id").cast("string"), "_label", "_text").mapInArrow(tidy(run), "id string, label double, features array<double>")
    taken = sorted(found.toLocalIterator(), key=lambda r: (zlib.crc32(r["id"].encode()), r["id"], r["features"]))
    features = np.array([r["features"] for r in taken]).reshape(len(taken), FEATURES)
    return vectors, Network.trained(features, np.array([r["label"] for r in taken]))


def scored(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", score: str = "score") -> DataFrame:
    """Every column of the documents, with the score added or replaced."""
    small_batches(docs.sparkSession)
    vectors, network = fitted(docs, labels, id_column, text)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    kept = docs.drop(score)
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            found = network.scores(pooled(batch.column(place).to_pylist(), vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, score])

    return kept.mapInArrow(tidy(run), StructType([*kept.schema.fields]).add(score, DoubleType()))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
