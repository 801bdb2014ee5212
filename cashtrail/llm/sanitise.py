"""Personal data: fixed patterns, and terms that give protected entities away.

Base spans are the leftmost matches of four patterns that pass their tests. Their
values are the protected entities. The method asks which ordinary terms reveal an
entity: over all documents,

    P(entity | term) = documents with both / documents with the term
    information      = log2(P(entity | term) / P(entity))

A document is a row, and every figure counts rows: a row repeated counts each time in
all of them. Terms are the words and numbers outside the entities, wherever in the
text they stand. A term is disclosed where P(entity | term) reaches ``GENERALISE``, the
two stand together in different texts, and the information reaches ``LEAST_BITS``. A
term of fewer than ``PLAIN`` characters must stand there with a capital, a letter
without case or a digit, as names and numbers do. In the cleaned text an entity
becomes its kind; a disclosed term becomes its shape, and from ``REMOVE`` on it is taken
out, at all its places in all documents.

A null or empty text has no spans. Rows meet their spans again by id and by a hash
of the text, so repeated rows, repeated ids and null ids are safe; further columns
are carried through. Positions count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail.llm import spans
from cashtrail.llm.common import documents, small_side, stored

KINDS = ("email", "ip", "card", "phone", "term")

# The base patterns, written so that no run of characters is tried
# twice: loops don't give back what they took, and a match starts where a run of its
# characters starts (or an e-mail where the last one ended). They match the same.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.|$)){4}$"

TERM = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*+(?:['-][\p{L}\p{N}][\p{L}\p{M}\p{N}]*+)*+"
PLAIN = 4  # from so many characters on any term counts
LIKE_A_NAME = r"[\p{Lu}\p{Lt}\p{Lo}\p{N}]"
GENERALISE, REMOVE = 0.5, 0.9
LEAST_BITS = 6.0
COMMON = 1000  # a common term is in more than one document of so many


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    doubled = F.transform(
        F.split(digits, ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int"))),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    """Base spans by kind as listed, then by start."""
    def long_enough(s: Column, least: int, most: int) -> Column:
        return F.length(_digits(s["value"])).between(least, most)

    emails = F.when(text.contains("@"), spans.found(text, EMAIL, "email")).otherwise(spans.none())
    ips = F.filter(spans.found(text, IP, "ip"), lambda s: s["value"].rlike(BYTE))
    cards = F.filter(spans.found(text, CARD, "card"), lambda s: long_enough(s, 16, 19))
    cards = F.filter(cards, lambda s: _luhn(s["value"]))
    phones = F.filter(spans.found(text, PHONE, "phone"), lambda s: long_enough(s, 8, 15))
    numbers = F.when(text.rlike("[0-9]"), F.concat(ips, cards, F.when(text.contains("+"), phones).otherwise(spans.none())))
    return F.concat(emails, F.coalesce(numbers, spans.none()))


def _blanked(text: Column, base: Column) -> Column:
    """The text with blanks in place of the spans; all positions stay."""
    ordered = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    walked = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(
                acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                F.repeat(F.lit(" "), s["end"] - F.greatest(acc["at"], s["start"])),
            ).alias("out"),
        ),
    )
    rest = lambda w: F.concat(w["out"], F.substring(text, w["at"] + 1, F.length(text)))
    return F.when(F.size(base) == 0, text).otherwise(rest(walked))


def _entity(kind: Column, value: Column) -> Column:
    """One name for an entity however it is written."""
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def _texts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``_id``, ``_hash`` of the text, ``base`` spans, and ``_t``: the text without them."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_column).alias("_id"), F.xxhash64(whole).alias("_hash"), whole.alias("_t"), base_spans(whole).alias("base"))
    return rows.withColumn("_t", _blanked(F.col("_t"), F.col("base")))


def found_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id``, ``_hash``, ``base`` spans, distinct ``terms``, and ``names``: the short terms that count, stored."""
    rows = _texts(docs, id_column, text).withColumn("_m", F.array_distinct(F.regexp_extract_all("_t", F.lit(TERM), F.lit(0))))
    names = F.filter("_m", lambda m: (F.length(m) < PLAIN) & m.rlike(LIKE_A_NAME))
    lower = lambda words: F.array_distinct(F.transform(words, F.lower))
    names = F.when(F.size("base") > 0, lower(names))
    return stored(rows.select("_id", "_hash", "base", lower(F.col("_m")).alias("terms"), names.alias("names")), "personal-spans")


def disclosing_terms(rows: DataFrame) -> DataFrame:
    """(term, share) of the terms that reveal an entity, stored.

    Entities and terms that can't reach the thresholds go before pairs are made: an
    entity in one text only, or in so many documents that no term tells enough; and a
    term in more than share * documents of the most frequent entity left.
    """
    total = rows.count()
    of_row = F.array_distinct(F.transform("base", lambda s: _entity(s["kind"], s["value"])))
    holding = rows.filter(F.size("base") > 0).select("_hash", "terms", "names", of_row.alias("entities"))
    two_texts = F.min("_hash") != F.max("_hash")
    entities = holding.select("_hash", F.explode("entities").alias("entity")).groupBy("entity")
    entities = entities.agg(F.count("*").alias("with_entity"), two_texts.alias("several")).filter("several").drop("several")
    entities = small_side(entities.filter(F.log2(total / F.col("with_entity")) >= LEAST_BITS))
    most = entities.agg(F.max("with_entity")).first()[0] or 0

    with_term = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("with_term")).filter("with_term > 1")
    with_term = stored(with_term, "term-counts")
    common = F.col("with_term") > max(most / GENERALISE, total / COMMON)
    hot = small_side(with_term.filter(common).select("term"))
    pairs = holding.select("_hash", "entities", "names", F.explode("terms").alias("term")).join(hot, "term", "left_anti")
    named = (F.length("term") >= PLAIN) | F.array_contains("names", F.col("term"))
    pairs = pairs.select("_hash", "term", named.alias("named"), F.explode("entities").alias("entity")).join(entities.select("entity"), "entity", "left_semi")
    together = pairs.groupBy("term", "entity").agg(F.count("*").alias("both"), two_texts.alias("several"), F.max("named").alias("named"))
    # what is left of a hot term is one row for each entity; adaptive execution splits it
    together = together.filter("several and named").select("term", "entity", "both").join(with_term.filter(~common), "term").join(entities, "entity")
    share = F.col("both") / F.col("with_term")
    bits = F.log2(share * total / F.col("with_entity"))
    return small_side(together.filter((share >= GENERALISE) & (bits >= LEAST_BITS)).groupBy("term").agg(F.max(share).alias("share")))


def disclosed_spans(docs: DataFrame, rows: DataFrame, terms: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``added``: the ``term`` spans of each (_id, _hash) with a disclosed term; the value says what becomes of them."""
    hits = rows.select("_id", "_hash", F.explode("terms").alias("term")).join(terms, "term")
    hits = hits.groupBy("_id", "_hash").agg(F.map_from_entries(F.collect_set(F.struct("term", "share"))).alias("shares"))
    found = _on_text(_texts(docs, id_column, text), small_side(hits))
    share = lambda s: F.col("shares")[F.lower(s["value"])]
    wanted = spans.found(F.col("_t"), TERM, "term", lambda m: F.map_contains_key("shares", F.lower(m)))
    found = found.filter("shares is not null").withColumn("_found", wanted)
    added = F.transform(
        "_found",
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.when(share(s) >= REMOVE, "remove").otherwise("generalise").alias("value")),
    )
    return small_side(found.select("_id", "_hash", added.alias("added")).dropDuplicates(["_id", "_hash"]))


def _on_text(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join by ``_id``, which may be null, and ``_hash``."""
    right = right.withColumnsRenamed({"_id": "_id_r", "_hash": "_hash_r"})
    return left.join(right, F.col("_id").eqNullSafe(F.col("_id_r")) & (F.col("_hash") == F.col("_hash_r")), "left").drop("_id_r", "_hash_r")


def scanned(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id``, ``_hash``, ``base`` and ``added`` spans for every row of the documents."""
    rows = found_spans(docs, id_column, text)
    added = disclosed_spans(docs, rows, disclosing_terms(rows), id_column, text)
    return _on_text(rows, added).select("_id", "_hash", "base", F.coalesce("added", spans.none()).alias("added"))


def _mark(whole: Column):
    def mark(s: Column) -> Column:
        word = F.substring(whole, s["start"] + 1, s["end"] - s["start"])
        shape = F.regexp_replace(F.regexp_replace(word, r"\p{Lu}+", "X"), r"\p{Ll}+", "x")
        return F.when(s["kind"] != "term", F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).when(s["value"] == "remove", "").otherwise(shape)

    return mark


def cleaned(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with entities replaced and disclosed terms generalised or removed.

    Texts with neither pass unchanged. ``length``, if the table has it, gets the new
    number of code points where the text changes.
    """
    rows = found_spans(docs, id_column, text)
    added = disclosed_spans(docs, rows, disclosing_terms(rows), id_column, text)
    # the caller's columns travel as one, apart from the working columns, whatever their names
    own = F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns])
    row = docs.select(own.alias("_row"))
    old = F.col("_row").getField(text)
    whole = F.coalesce(old, F.lit(""))
    joined = _on_text(row.select("_row", F.col("_row").getField(id_column).alias("_id"), F.xxhash64(whole).alias("_hash"), base_spans(whole).alias("_base")), added)
    joined = joined.withColumn("_spans", spans.by_start(F.concat("_base", F.coalesce("added", spans.none())), KINDS))
    touched = F.size("_spans") > 0
    changed = joined.withColumn("_new", F.when(touched, spans.replaced(old, F.col("_spans"), _mark(old))).otherwise(old))
    out = {c: F.col("_row").getField(c) for c in docs.columns} | {text: F.col("_new")}
    if length and length in docs.columns:
        out[length] = F.when(touched, F.length("_new").cast(docs.schema[length].dataType)).otherwise(out[length])
    return changed.select(*[column.alias(c) for c, column in out.items()])


def op5_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(documents(spark, sf_dir).select("doc_id", "text"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    order = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(
        F.transform(
            F.concat("base", "added"),
            lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )
    return rows.select(
        F.col("_id").alias("doc_id"),
        *[number(k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"),
        spans.joined(every).alias("spans"),
    )
