"""How far the word use of each source lies from the others of its language.

A group is a language and a source. Terms are runs of ASCII letters and of characters
beyond ASCII, A-Z lower-cased; a language keeps the terms in at least ``least_docs`` of
its documents. With c occurrences of a kept term in a group, N of all kept terms there
and V kept terms, p = 1 + floor(10^9 (c + 1) / (N + V)), and the price of a term for the
group against q is floor((p - q)^2 / q). All numbers are whole.

Every unordered pair of sources is one task of a sparse merge. Kept terms are dealt into
slices by hash, numbered inside a slice from the most to the least frequent, and a group
has one sorted array of (term id, count) for each slice. Two groups' arrays are
co-grouped and the shorter one gallops through the longer one: an id never stands behind
its own number, so the search starts there and doubles its steps downwards. That leaves
terms of both, of one and of the other, all priced in both directions; what neither has
is one price times a number, added at the end. Pair tasks travel in tiles of sources, so
an array is copied once per tile of partners and not once per partner. The number of
slices follows the counts kept, so no task holds more than a few slices of a tile.

Null text, language or source counts as ''. Empty texts and texts without a term make a
group occur; a language without kept terms has pairs of value 0 and no terms. Repeated
rows are documents of their own, whatever their ids, which are not read. Ties in a rank go
by the item's UTF-8 bytes. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail.llm.common import documents, small_batches, small_side, stored, tidy

UNIT = 10**9
LEAST_DOCS = 3
RANKS = 200  # terms reported for each group
TILE = 8  # sources that travel together
SLICE = 1 << 18  # counts in a slice, about
HELD = 250_000  # counts a worker holds before it hands them on

# every byte but letters and parts of characters beyond ASCII becomes a blank
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = "lang string, source string, term string, n long, docs long"
_SLICED = "lang string, slice long, source string, ids binary, counts binary"
_PRICED = "lang string, a string, b string, ab long, ba long, met long"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    held = 0

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            if n:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(lang, pa.string()), len(n)),
                        pa.repeat(pa.scalar(source, pa.string()), len(n)),
                        pa.array(list(n), pa.binary()).cast(pa.string()),
                        pa.array(list(n.values()), pa.int64()),
                        pa.array([docs[t] for t in n], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    for batch in batches:
        for lang, source, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            n, docs = found[lang, source]
            before = len(n)
            terms = terms_of(text)
            n.update(terms)
            docs.update(set(terms))
            held += len(n) - before
            if held >= HELD:
                yield from handed_on()
                found.clear()
                held = 0
    yield from handed_on()


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, docs, n, sources, counts): one row per kept term, with its counts by source."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # Workers have added up what they saw; the rest of a term meets in one place.
    partial = rows.mapInArrow(tidy(_counted), _COUNTED).repartition("lang", "term")
    each = partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (
        each.groupBy("lang", "term")
        .agg(
            F.sum("docs").alias("docs"),
            F.sum("n").alias("n"),
            F.collect_list("source").alias("sources"),
            F.collect_list("n").alias("counts"),
        )
        .filter(F.col("docs") >= least_docs)
    )


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (c + 1) / (N + V)), by long division: exact below 9 x 10^15 occurrences."""
    left, out = counts + 1, np.zeros(len(counts), dtype=np.int64)
    for _ in range(3):
        whole, left = np.divmod(left * 1000, total + terms)
        out = out * 1000 + whole
    return out + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the ids of ``short`` stand or would stand in ``long``, and whether they are there."""
    if not len(short) or not len(long):
        return np.zeros(len(short), dtype=np.int64), np.zeros(len(short), dtype=bool)
    high = np.minimum(short, len(long) - 1).astype(np.int64)  # long[i] >= i, so never further on
    low, step = high.copy(), 1
    open_ = np.flatnonzero(long[low] > short)
    while len(open_):
        low[open_] = np.maximum(low[open_] - step, 0)
        step *= 2
        open_ = open_[(long[low[open_]] > short[open_]) & (low[open_] > 0)]
    while (wide := np.flatnonzero(low < high)).size:  # the last place with an id of at most this one
        middle = (low[wide] + high[wide] + 1) // 2
        at_most = long[middle] <= short[wide]
        low[wide] = np.where(at_most, middle, low[wide])
        high[wide] = np.where(at_most, high[wide], middle - 1)
    return low, long[low] == short


def merged(a: tuple, b: tuple) -> tuple[int, int, int]:
    """Prices of a against b and of b against a over the terms of either, and how many these are.

    A group is (ids, counts, occurrences of all kept terms, kept terms).
    """
    if len(a[0]) > len(b[0]):
        ba, ab, met = merged(b, a)
        return ab, ba, met
    at, both = gallop(a[0], b[0])
    p, q = shares(a[1], a[2], a[3]), shares(b[1], b[2], b[3])
    p0, q0 = (shares(np.zeros(1, dtype=np.int64), g[2], g[3]) for g in (a, b))
    rest = np.ones(len(q), dtype=bool)
    rest[at[both]] = False
    ab = ba = 0
    for x, y in ((p[both], q[at[both]]), (p[~both], q0), (p0, q[rest])):
        ab += int(price(x, y).sum()) if max(len(x), len(y)) and min(len(x), len(y)) else 0
        ba += int(price(y, x).sum()) if max(len(x), len(y)) and min(len(x), len(y)) else 0
    return ab, ba, len(p) + int(rest.sum())


def _slices(kept: DataFrame, entries: int) -> DataFrame:
    """A row for each group and slice with its sorted ids and their counts."""
    slices = max(1, -(-entries // SLICE))

    def number(table: pa.Table) -> pa.Table:
        lang, slice_ = table.column("lang")[0].as_py(), table.column("slice")[0].as_py()
        table = table.sort_by([("docs", "descending"), ("term", "ascending")])
        sources, counts = table.column("sources").combine_chunks(), table.column("counts").combine_chunks()
        ids = np.repeat(np.arange(len(table), dtype=np.int32), np.diff(sources.offsets.to_numpy()))
        names = sources.flatten().dictionary_encode()
        n = counts.flatten().to_numpy()
        order = np.argsort(names.indices.to_numpy(), kind="stable")  # ids stay sorted
        ends = np.cumsum(np.bincount(names.indices.to_numpy(), minlength=len(names.dictionary)))[:-1]
        out = [(x.tobytes(), y.tobytes()) for x, y in zip(np.split(ids[order], ends), np.split(n[order], ends))]
        return pa.table(
            {
                "lang": pa.array([lang] * len(out), pa.string()),
                "slice": pa.array([slice_] * len(out), pa.int64()),
                "source": names.dictionary,
                "ids": pa.array([x for x, _ in out], pa.binary()),
                "counts": pa.array([y for _, y in out], pa.binary()),
            }
        )

    dealt = kept.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(slices)))
    return dealt.groupBy("lang", "slice").applyInArrow(number, _SLICED)


def _pair_tasks(left: pa.Table, right: pa.Table) -> pa.Table:
    def groups(table: pa.Table) -> dict[str, tuple]:
        out = {}
        for row in table.select(["source", "ids", "counts", "total", "terms"]).to_pylist():
            ids = np.frombuffer(row["ids"] or b"", dtype=np.int32)
            out[row["source"]] = (ids, np.frombuffer(row["counts"] or b"", dtype=np.int64), row["total"], row["terms"])
        return out

    first, second = groups(left), groups(right)
    found = [(a, b, *merged(first[a], second[b])) for a in sorted(first) for b in sorted(second) if a < b]
    langs = [left.column("lang")[0].as_py()] * len(found) if found else []
    columns = list(zip(*found)) if found else [[]] * 5
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(langs, pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["lang", "a", "b", "ab", "ba", "met"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to other sources, and telling terms."""
    kept = stored(kept_terms(docs, least_docs), "terms")
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    occurring = docs.select(*names).distinct()
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("all"), F.sum(F.size("sources")).alias("entries"))
    each = kept.select("lang", "term", "n", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select(
        "lang", "term", F.col("n").alias("lang_n"), F.col("e.sources").alias("source"), F.col("e.counts").alias("n")
    )
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    facts = occurring.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "all", "entries", "total"])
    place = "cast((row_number() OVER (PARTITION BY lang ORDER BY source) - 1) div {} as int)".format(TILE)
    facts = stored(facts.withColumn("tile", F.expr(place)), "groups")
    tiles = facts.groupBy("lang").agg(F.max("tile").alias("last"))
    entries = facts.select("lang", "entries").distinct().agg(F.sum("entries")).first()[0] or 0

    sliced = stored(_slices(kept, entries), "slices")
    # a group without a term of a slice still meets the others there
    wanted = facts.join(sliced.select("lang", "slice").distinct(), "lang").join(tiles, "lang")
    arrays = wanted.join(sliced, ["lang", "slice", "source"], "left").select(
        "lang", "slice", "source", "ids", "counts", "total", "terms", "tile", "last"
    )
    arrays = stored(arrays, "arrays")
    left = arrays.withColumn("one", F.col("tile")).withColumn("two", F.explode(F.sequence("tile", "last")))
    right = arrays.withColumn("two", F.col("tile")).withColumn("one", F.explode(F.sequence(F.lit(0), "tile")))
    task = ["lang", "slice", "one", "two"]
    priced = left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(_pair_tasks, _PRICED)
    summed = priced.groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in ("ab", "ba", "met")])

    one = facts.select("lang", "source", "terms", F.col("total").alias("own"))
    two = facts.select("lang", F.col("source").alias("item"), F.col("total").alias("other"))
    pairs = one.join(two, "lang").filter("source <> item").withColumns({"a": F.least("source", "item"), "b": F.greatest("source", "item")})
    p, q = (f"(1 + {UNIT} div ({n} + terms))" for n in ("own", "other"))
    pairs = pairs.join(summed, ["lang", "a", "b"], "left").na.fill(0, ["ab", "ba", "met"])
    pairs = pairs.withColumn(
        "value",
        F.expr(f"CASE WHEN terms = 0 THEN 0 ELSE IF(source < item, ab, ba) + (terms - met) * (({p} - {q}) * ({p} - {q}) div {q}) END").cast("long"),
    )
    order = "row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)"
    pairs = pairs.selectExpr("lang", "source", "'pair' AS part", "item", "value", f"{order} AS rank")

    known = small_side(facts.select("lang", "source", "total", "all", "terms"))
    share = f"1 + {UNIT} * cast(%s + 1 as decimal(20, 0)) div (%s + terms)"
    told = each.join(known, ["lang", "source"]).withColumns({"p": F.expr(share % ("n", "total")), "q": F.expr(share % ("lang_n", "all"))})
    told = told.filter("p > q").selectExpr("lang", "source", "'term' AS part", "term AS item", "(p - q) * (p - q) div q AS value")
    told = told.selectExpr("*", f"{order} AS rank").filter(F.col("rank") <= ranks)
    return pairs.unionByName(told)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT row) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
e AS (SELECT c.* FROM c JOIN k USING (lang, term)),
g AS (
  SELECT g.lang, g.source, coalesce(any_value(v.v), 0) AS v, coalesce(any_value(v.n), 0) AS lang_n, coalesce(sum(e.n), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN v USING (lang) LEFT JOIN e USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(e.n, 0) AS n, 1 + (1000000000 * (coalesce(e.n, 0) + 1)) // (g.n + g.v) AS p,
    1 + (1000000000 * (k.n + 1)) // (g.lang_n + g.v) AS q
  FROM g JOIN k USING (lang) LEFT JOIN e USING (lang, source, term)),
x AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 200
"""
