"""Quality rules per document and per host.

Every text is measured by itself. Then the failures are counted by host, the
failure rate of each host is shrunk towards the rate of all hosts with a beta
prior fitted to the hosts by the method of moments, and a host whose shrunk rate
is above the limit is rejected with all its documents.

A null or empty text has no words and fails. A null host is a host of its own.
Documents are never joined by their id, so null and repeated ids, repeated rows
and further columns are carried through; a column named like a result is replaced.
Windows of three words are compared by a 64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail.llm.common import BLANKS, NOT_BLANK, documents, free_names, small_side, stored, words_of

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
HOST_LIMIT = 0.5
SYMBOLS = "#*$%&|<>"
WINDOW = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(ordered: Column) -> Column:
    """Words under a window that occurs again, from (hash, position) pairs in order."""
    last = F.size(ordered) - 1
    again = F.filter(
        ordered,
        lambda x, i: ((i > 0) & (x["h"] == F.get(ordered, i - 1)["h"])) | ((i < last) & (x["h"] == F.get(ordered, i + 1)["h"])),
    )
    words = F.transform(again, lambda x: F.array(*[x["i"] + k for k in range(WINDOW)]))
    return F.size(F.array_distinct(F.flatten(words)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the five measures and ``base_failed`` to every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(NOT_BLANK))
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() not in {*MEASURES, "base_failed"}]
    word_list, line_list, hashes, ordered = free_names(docs, "_words", "_lines", "_windows", "_ordered")
    out = docs.select(*kept, words_of(F.col(text)).alias(word_list), lines.alias(line_list))
    windows = F.transform(
        F.sequence(F.lit(0), F.size(word_list) - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col(word_list), i + k) for k in range(WINDOW)]),
    )
    out = out.select(
        *kept,
        F.size(word_list).cast("long").alias("n_words"),
        F.length(F.regexp_replace(whole, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(line_list) - F.size(F.array_distinct(line_list))).cast("long").alias("n_dup_lines"),
        F.when(F.size(word_list) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias(hashes),
    )
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    out = out.withColumn(ordered, F.when(repeated, F.sort_array(pairs))).drop(hashes)
    out = out.withColumn(
        "n_repeat_words", F.when(F.col(ordered).isNull(), 0).otherwise(_covered(F.col(ordered))).cast("long")
    ).drop(ordered)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return out.withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: documents, failures, shrunk rate and verdict.

    With mean m and variance v of the hosts' rates the prior has the strength
    m(1-m)/v - 1; hosts that do not differ, or a single host, get their common
    rate, as if the prior were infinitely strong.
    """
    hosts = rows.groupBy(F.col(host).alias("_host")).agg(
        F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")
    )
    rate = F.col("host_failed") / F.col("host_docs")
    found = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    mean, spread = found["m"] or 0.0, found["v"] or 0.0
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else None
    if strength is None or strength <= 0:
        shrunk = F.lit(mean) if strength is None else rate
    else:
        shrunk = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", F.col("host_rate") <= limit)


def judged(docs: DataFrame, host: str = "source", text: str = "text", limit: float = HOST_LIMIT,
           keep_text: bool = False) -> DataFrame:
    """Measures, host verdict and ``kept`` for every document.

    The measures are written once and read by the host statistics and by the
    join. Without ``keep_text`` the text is not carried along.
    """
    rows = measured(docs, text)
    rows = stored(rows if keep_text else rows.drop(text), "host-rules")
    (name,) = free_names(rows, "_host")
    verdicts = host_verdicts(rows, host, limit).select(F.col("_host").alias(name), "host_rate", "host_kept")
    rows = rows.drop("host_rate", "host_kept", "kept")
    out = rows.join(small_side(verdicts, 100_000), F.col(host).eqNullSafe(F.col(name)), "left").drop(name)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", *MEASURES, "base_failed", "kept")


# Words that lie in windows are counted by position; the rest mirrors the measures.
OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM p),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
c AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r WHERE n > 1) GROUP BY rid),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k, sum(base_failed::INT) / count(*) AS r FROM f GROUP BY source),
q AS (SELECT avg(r) AS m, var_pop(r) AS v FROM h),
z AS (
  SELECT source, CASE WHEN v = 0 THEN m
                      WHEN m * (1 - m) / v - 1 <= 0 THEN r
                      ELSE (k + m * (m * (1 - m) / v - 1)) / (n + m * (1 - m) / v - 1) END AS rate
  FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= 0.5 AS kept
FROM f JOIN z ON f.source IS NOT DISTINCT FROM z.source
"""
