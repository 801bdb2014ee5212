"""I-Match fingerprints from randomised lexicons, in built-in functions only.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z
lower-cased, known by 64-bit hashes. The lexicon holds the terms whose share of all
documents lies in a band (``RARE`` to ``COMMON``, and two documents at least): inverse
document frequencies in between. A text's distinct terms of the lexicon are sorted and
hashed, once whole and once for each of 60 randomised subsets of the lexicon: six
families of ten nested subsets, each with half the terms of the one before it. Long
texts still agree on small subsets after an edit, short texts on large ones.

The fingerprint lists these 61 hashes of 32 bits, an empty one where a subset holds no
term of the text. A text without a term of the lexicon is known by a hash of itself.
``likeness`` is the share of equal hashes among those that either text has, 1 for equal
texts.

At most (distinct terms of a mean text) / RARE terms can stand in so large a share of all
documents, whatever their number; that bounds the lexicon, which goes to every task as
one hashed array. Each document finds its successor by a window in parts of about
sqrt(rows) rows, bounded by ids, with the first row of the next part as a guest; the list
of bounds grows with the root of the rows. Ids that fill several parts are dealt by
their texts' hashes.

Null texts count as empty: no characters, and an edited text that is empty too. Rows
without an id come last, by hash of their text, as do rows that share an id among
themselves. Repeated rows are documents of their own in every count. A single document
is its own successor. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashtrail.llm.common import ascii_lower, documents, small_side, stored

RARE, COMMON = 0.001, 0.1  # of all documents
FAMILIES, LEVELS = 6, 10
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LAST = (1 << 63) - 1  # stands for a missing id


def term_hashes(text: Column) -> Column:
    """64-bit hashes of a text's terms, in order, with repeats; also of '' at an end that is no term."""
    return F.transform(F.split(ascii_lower(text), APART), lambda w: F.xxhash64(w))


def lexicon(texts: DataFrame, rare: float = RARE, common: float = COMMON) -> DataFrame:
    """One row with the terms of the band, as an array of cells by the terms' last bits."""
    n = texts.count()
    terms = texts.select(F.explode(F.array_distinct(term_hashes(F.col("text")))).alias("term")).groupBy("term").count()
    terms = terms.filter(F.col("term") != F.xxhash64(F.lit("")))
    within = (F.col("count") >= max(2, math.ceil(rare * n))) & (F.col("count") <= max(2, math.floor(common * n)))
    chosen = stored(terms.filter(within).select("term"), "lexicon")
    size = 1 << max(0, math.ceil(math.log2(max(1, chosen.count()))))
    cells = texts.sparkSession.range(size).withColumnRenamed("id", "cell")
    filled = chosen.groupBy(F.col("term").bitwiseAND(F.lit(size - 1)).alias("cell")).agg(F.collect_list("term").alias("terms"))
    placed = cells.join(filled, "cell", "left").select("cell", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms"))
    whole = placed.agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "terms"))), lambda x: x["terms"]).alias("cells"))
    return stored(whole, "cells")


def with_marks(rows: DataFrame, cells: DataFrame, text: Column, marks: str) -> DataFrame:
    """Adds the hashes of the whole lexicon and of its subsets, null where no term is left."""
    table, last = f"{marks}_cells", cells.select(F.size("cells") - 1).first()[0]
    in_band = F.filter(F.array_distinct(term_hashes(text)), lambda t: F.array_contains(F.get(table, t.bitwiseAND(F.lit(last)).cast("int")), t))
    whole, levels = f"{marks}_all", [f"{marks}_{f}" for f in range(FAMILIES)]
    # One reference to the table, so that the optimizer moves the subquery there and no row carries it.
    out = rows.withColumn(table, cells.scalar()).withColumns(
        {whole: F.sort_array(in_band), marks: _hash(F.array(F.xxhash64(F.lit("text"), text)))}
    )
    out = out.drop(table).withColumn(marks, F.array(F.coalesce(_hash(F.col(whole)), F.col(marks))))
    out = out.withColumns({c: F.col(whole) for c in levels})
    for level in range(LEVELS):
        # a family reads bits of its own of the term's hash, one for each level
        out = out.withColumns({c: F.filter(c, _without(LEVELS * f + level)) for f, c in enumerate(levels)})
        out = out.withColumn(marks, F.concat(marks, F.array(*[_hash(F.col(c)) for c in levels])))
    return out.drop(whole, *levels)


def _without(bit: int) -> Callable[[Column], Column]:
    return lambda t: t.bitwiseAND(F.lit(1 << bit)) == 0


def _hash(terms: Column) -> Column:
    return F.when(F.size(terms) > 0, F.xxhash64(terms).bitwiseAND(F.lit(0xFFFFFFFF)))


def fingerprint(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda m: F.coalesce(F.lower(F.hex(m)), F.lit(""))), ".")


def likeness(one: Column, two: Column) -> Column:
    both = F.filter(F.arrays_zip(one.alias("a"), two.alias("b")), lambda m: m["a"].isNotNull() | m["b"].isNotNull())
    return F.size(F.filter(both, lambda m: m["a"] == m["b"])) / F.size(both)


def _bounds(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """First (key, hash) of each part but the first; a key that fills several is cut by hash."""
    wanted = [i / parts for i in range(1, parts)]
    keys = rows.agg(F.percentile_approx("key", F.array(*[F.lit(x) for x in wanted]) if wanted else F.array(F.lit(0.5)), 4 * parts)).first()[0]
    keys = (keys or [])[: len(wanted)]
    out = []
    for key in sorted(set(keys)):
        m = keys.count(key)
        out += [(key, -(1 << 63) + (i << 64) // m) for i in range(m)]
    return out


def _literal(numbers: list[int]) -> Column:
    text = ",".join(map(str, numbers))  # folded into one array by the optimizer
    return F.split(F.lit(text), ",").cast("array<bigint>") if numbers else F.array().cast("array<bigint>")


def _part(bounds: list[tuple[int, int]]) -> Column:
    """How many bounds a row has reached, by halving steps."""
    keys, hashes = _literal([k for k, _ in bounds]), _literal([h for _, h in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(bounds).bit_length())))])

    def step(at: Column, jump: Column) -> Column:
        key, hash_ = F.get(keys, at + jump - 1), F.get(hashes, at + jump - 1)
        reached = (key < F.col("key")) | ((key == F.col("key")) & (hash_ <= F.col("hash")))
        return F.when(reached, at + jump).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def followed(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, text, marks, next_text, next_marks): each document with the one after it."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("key")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key)
    rows = rows.withColumn("hash", F.xxhash64("text"))
    n = rows.count()
    placed = rows.withColumn("part", _part(_bounds(rows, max(1, math.ceil(math.sqrt(n))))))
    # the first row of each part stands at the end of the part before it, of the first part at the end of the last
    firsts = placed.groupBy("part").agg(F.min(F.struct("key", "hash")).alias("first")).selectExpr("part", "first.key AS key", "first.hash AS hash")
    firsts = firsts.selectExpr("*", "coalesce(lag(part) OVER (ORDER BY part), max(part) OVER ()) AS home")
    guests = placed.join(small_side(firsts), ["part", "key", "hash"]).groupBy("home").agg(F.min("text").alias("text"))
    guests = guests.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", f"{_LAST} AS key", "0L AS hash", "home AS part", "true AS guest")
    together = placed.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("guest", F.lit(False)).unionByName(guests)
    together = with_marks(together, cells, F.col("text"), "marks")
    after = "lead(%s) OVER (PARTITION BY part ORDER BY guest, key, hash, text) AS next_%s"
    found = together.selectExpr("*", after % ("text", "text"), after % ("marks", "marks")).filter("NOT guest")
    kind = docs.schema["doc_id"].dataType
    return found.select(F.col("doc_id").cast(kind) if isinstance(kind, T.IntegralType) else "doc_id", "text", "marks", "next_text", "next_marks")


def fingerprints(docs: DataFrame, rare: float = RARE, common: float = COMMON) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and likenesses."""
    cells = lexicon(docs.select(F.coalesce("text", F.lit("")).alias("text")), rare, common)
    rows = followed(docs, cells)
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = with_marks(rows, cells, edited, "edited_marks")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("marks")).alias("fingerprint"),
        fingerprint(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )


def op12_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir).select("doc_id", "text"))
