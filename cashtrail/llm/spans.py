"""Positions of pattern matches, from built-in functions only.

A text is cut at the matches; the lengths of the pieces and of the matches add up
to the positions. All positions count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,value:string>"


def found(text: Column, pattern: str, kind: str, wanted=None) -> Column:
    """Leftmost matches that do not overlap, as an array of SPAN.

    A null or empty text and a text without a match give an empty array. The
    pattern must not match the empty string. ``wanted(match)`` says which of them to keep.
    """
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.struct(m.alias("m"), p.alias("p")))

    def longer(acc: Column, x: Column) -> Column:
        more = F.concat(
            acc["out"],
            F.array(
                F.struct(
                    F.lit(kind).alias("kind"),
                    (acc["at"] + F.length(x["p"])).alias("start"),
                    (acc["at"] + F.length(x["p"]) + F.length(x["m"])).alias("end"),
                    x["m"].alias("value"),
                )
            ),
        )
        return more if wanted is None else F.when(wanted(x["m"]), more).otherwise(acc["out"])

    walked = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
            longer(acc, x).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(none())


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def joined(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def by_start(spans: Column, kinds: tuple[str, ...]) -> Column:
    """Ordered by start, then by kind as listed, then by end."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"),
            s["kind"].alias("kind"), s["value"].alias("value"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"]))


def replaced(text: Column, spans: Column, mark) -> Column:
    """The text with each span replaced by ``mark(span)``.

    Spans come ordered by start; of overlapping ones the first counts and the
    text of a later one that sticks out beyond it is removed with it.
    """
    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark(s)).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(walked["out"], F.substring(text, walked["at"] + 1, F.length(text)))
    )
