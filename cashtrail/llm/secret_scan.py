"""Secrets in texts: fixed patterns, and windows of high entropy in long strings.

Base spans are the leftmost matches of three patterns. The method adds ``entropy``
spans: a window slides over every long run of key characters; the counts of its
characters, and with them the sum that gives Shannon's entropy, change by the
character that enters and the one that leaves. The threshold depends on the class
of the characters in the run. Runs on the allow-list (words, paths, numbers,
repeated patterns, placeholders) are passed over, and so is a run inside a base span.

A null or empty text has no spans. Rows are handled one by one: repeated rows,
null ids and further columns change nothing. Positions count code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail.llm import spans
from cashtrail.llm.common import documents

KINDS = ("assign", "access", "hex", "entropy")

# The base patterns and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters and more
HEX = r"[0-9a-f]{24,}"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
# Class of a run (the first that fits) and the entropy in bits from which a window counts.
CLASSES = (("hex", r"^[0-9a-f]+$|^[0-9A-F]+$", 3.0), ("upper", r"^[A-Z0-9]+$", 3.5), ("mixed", r"", 3.7))
# A run that fits one of these is no secret.
ALLOWED = (
    r"^[A-Za-z+/_=-]*$",  # words and paths without a digit
    r"^[0-9+/_=-]*$",  # numbers, dates, rules
    r"^(.{1,8}?)\1+.{0,8}$",  # a short pattern again and again
    r"^[A-Za-z]+[0-9]{1,4}$",  # a word with a number
    r"^(?:[a-z0-9]++[-_/])++[a-z]+[0-9]{0,2}$",  # slugs and paths
    r"(?i)example|placeholder|changeme|xxxx|dummy|abcdef|012345",
)


def _hot_range(run: Column, limit: Column) -> Column:
    """First and past-the-last character of the windows whose entropy reaches the limit."""
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])

    def moved(counts: Column, slot: Column, by: int) -> Column:
        return F.transform(counts, lambda c, i: F.when(i == slot, c + by).otherwise(c))

    def slot_at(i: Column) -> Column:
        return F.position(F.substring(run, i + 1, F.lit(1)), F.lit(ALPHABET))

    def enter(acc: Column, i: Column) -> Column:
        slot = slot_at(i) - 1
        had = F.get(acc["counts"], slot)
        return F.struct(
            moved(acc["counts"], slot, 1).alias("counts"),
            (acc["sum"] - F.get(terms, had) + F.get(terms, had + 1)).alias("sum"),
            acc["first"].alias("first"),
            acc["last"].alias("last"),
        )

    def leave(acc: Column, i: Column) -> Column:
        slot = slot_at(i - WINDOW) - 1
        had = F.get(acc["counts"], slot)
        return F.struct(
            moved(acc["counts"], slot, -1).alias("counts"),
            (acc["sum"] - F.get(terms, had) + F.get(terms, had - 1)).alias("sum"),
            acc["first"].alias("first"),
            acc["last"].alias("last"),
        )

    def seen(acc: Column, i: Column) -> Column:
        hot = (i >= WINDOW - 1) & (math.log2(WINDOW) - acc["sum"] / WINDOW >= limit)
        return F.struct(
            acc["counts"].alias("counts"),
            acc["sum"].alias("sum"),
            F.when(hot & (acc["first"] < 0), i - WINDOW + 1).otherwise(acc["first"]).alias("first"),
            F.when(hot, i + 1).otherwise(acc["last"]).alias("last"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"),
        F.lit(-1).alias("first"), F.lit(-1).alias("last"),
    )
    # Each step is an aggregate of its own, over one or two moves, so that no state is computed twice.
    indexes = F.sequence(F.lit(0), F.length(run) - 1)
    moves = F.flatten(
        F.transform(
            indexes,
            lambda i: F.when(i >= WINDOW, F.array(F.struct(i.alias("i"), F.lit(0).alias("do")), F.struct(i.alias("i"), F.lit(1).alias("do")), F.struct(i.alias("i"), F.lit(2).alias("do"))))
            .otherwise(F.array(F.struct(i.alias("i"), F.lit(0).alias("do")), F.struct(i.alias("i"), F.lit(2).alias("do")))),
        )
    )
    return F.aggregate(
        moves,
        start,
        lambda acc, m: F.when(m["do"] == 0, enter(acc, m["i"])).when(m["do"] == 1, leave(acc, m["i"])).otherwise(seen(acc, m["i"])),
        lambda acc: F.struct(acc["first"], acc["last"]),
    )


def entropy_spans(text: Column, base: Column) -> Column:
    """``entropy`` spans outside the base spans, in order."""
    runs = F.filter(
        spans.found(text, CANDIDATE, "entropy"),
        lambda s: ~F.exists(F.array(*[s["value"].rlike(p) for p in ALLOWED]), lambda x: x)
        & ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])),
    )

    def narrowed(s: Column) -> Column:
        limit = F.lit(CLASSES[-1][2])
        for _, pattern, least in reversed(CLASSES[:-1]):
            limit = F.when(s["value"].rlike(pattern), least).otherwise(limit)
        return F.struct(s.alias("s"), _hot_range(s["value"], limit).alias("r"))

    hot = F.filter(F.transform(runs, narrowed), lambda x: x["r"]["first"] >= 0)
    return F.transform(
        hot,
        lambda x: F.struct(
            F.lit("entropy").alias("kind"),
            (x["s"]["start"] + x["r"]["first"]).alias("start"),
            (x["s"]["start"] + x["r"]["last"]).alias("end"),
            F.substring(x["s"]["value"], x["r"]["first"] + 1, x["r"]["last"] - x["r"]["first"]).alias("value"),
        ),
    )


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base`` and ``added``, arrays of spans, to every row."""
    column = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(
        spans.found(column, ASSIGN, "assign"),
        lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LEAST,
    )
    found = F.concat(assign, spans.found(column, ACCESS, "access"), spans.found(column, HEX, "hex"))
    out = docs.drop("base", "added").withColumn("base", spans.by_start(found, KINDS))
    added = F.when(column.rlike(CANDIDATE), entropy_spans(column, F.col("base"))).otherwise(spans.none())
    return out.withColumn("added", added)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(documents(spark, sf_dir).select("doc_id", "text")).drop("text")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"),
        spans.joined(spans.by_start(F.concat("base", "added"), KINDS)).alias("spans"),
    )
