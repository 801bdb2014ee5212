"""Preference pairs as one prompt and two masked completions.

Two conversations agree on a longest prefix of turns. The prefix is rendered once as
the prompt; what is left of each conversation is its completion. A completion comes
with the spans to learn from: the words of assistant turns and the mark that ends
them. Everything else, prompt included, is masked.

A turn without a role has the role ``none``, a turn without text an empty one; two
turns agree if role and text do, nulls with nulls. Equal conversations leave two empty
completions, a null conversation counts as one without turns. Marks inside a text are
broken up. Positions count code points. Further columns are carried through, except
those named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail.llm.common import free_names

OPEN, CLOSE = "<|", "|>"
TURN_END = "<|end|>\n"
LEARNT = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("none")), F.lit(CLOSE + "\n"))


def _words(turn: Column) -> Column:
    return F.concat(F.replace(F.coalesce(turn["text"], F.lit("")), F.lit(OPEN), F.lit("< |")), F.lit(TURN_END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _words(t))), "")


def learnt_spans(turns: Column) -> Column:
    """``start:end`` of what is learnt from in the rendered turns, joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(_words(t))
        spans = F.when(t["role"] == LEARNT, F.concat(acc["spans"], F.array(F.concat_ws(":", begin, end)))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["spans"]), ",")


def common_turns(one: Column, other: Column) -> Column:
    """Length of the longest common prefix of turns."""
    both = F.least(F.size(one), F.size(other))
    same = F.zip_with(F.slice(one, 1, both), F.slice(other, 1, both), lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(both).cast("int")


def formatted(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replace the two conversations by prompt, completions and spans."""
    results = {"n_prompt_turns", "prompt", "chosen_text", "chosen_spans", "rejected_text", "rejected_spans"}
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in pairs.columns if c.lower() not in results | {chosen.lower(), rejected.lower()}]
    sides = [F.coalesce(F.col(c).cast(TURNS), F.array().cast(TURNS)) for c in (chosen, rejected)]
    one, other, prompt = free_names(pairs, "_one", "_other", "_prompt")
    rows = pairs.select(*kept, sides[0].alias(one), sides[1].alias(other))
    rows = rows.withColumn("n_prompt_turns", common_turns(F.col(one), F.col(other)))
    after = F.col("n_prompt_turns") + 1
    rows = rows.select(
        *kept, "n_prompt_turns",
        F.slice(one, F.lit(1), F.col("n_prompt_turns")).alias(prompt),
        F.slice(one, after, F.size(one)).alias(one),
        F.slice(other, after, F.size(other)).alias(other),
    )
    return rows.select(
        *kept, "n_prompt_turns", rendered(F.col(prompt)).alias("prompt"),
        rendered(F.col(one)).alias("chosen_text"), learnt_spans(F.col(one)).alias("chosen_spans"),
        rendered(F.col(other)).alias("rejected_text"), learnt_spans(F.col(other)).alias("rejected_spans"),
    )


def stale_reply_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) of every conversation.

    Chosen is the conversation up to its last reply. Rejected gives the reply before
    it once more instead, or ends where there is none. A conversation without a reply
    is both. Turns that share a number are ordered by role and text; turns without
    a conversation id belong to none and are left out.
    """
    turn = F.struct("turn", "role", "text")
    whole = conversations.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    whole = whole.withColumn("_turns", F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    places = F.filter(F.sequence(F.lit(1), F.size("_turns")), lambda i: F.get("_turns", i - 1)["role"] == LEARNT)
    whole = whole.withColumn("_places", places)
    last, before = F.element_at("_places", -1), F.get("_places", F.size("_places") - 2)
    stale = F.when(F.size("_places") > 1, F.array(F.get("_turns", before - 1))).otherwise(F.array().cast(TURNS))
    replied = F.size("_places") > 0
    return whole.select(
        "conv_id",
        F.when(replied, F.slice("_turns", F.lit(1), last)).otherwise(F.col("_turns")).alias("chosen"),
        F.when(replied, F.concat(F.slice("_turns", F.lit(1), last - 1), stale)).otherwise(F.col("_turns")).alias("rejected"),
    )


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(stale_reply_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP2_SQL = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
         '<|' || role || '|>' || chr(10) AS head, replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, i, head, body, text, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM t WHERE role = 'assistant'),
e AS (
  SELECT c.conv_id, l.i AS last, l.head AS head, l.body AS body, p.body AS stale, coalesce(p.text = l.text, false) AS same
  FROM (SELECT DISTINCT conv_id FROM t) c
  LEFT JOIN a l ON l.conv_id = c.conv_id AND l.back = 1 LEFT JOIN a p ON p.conv_id = c.conv_id AND p.back = 2),
m AS (
  SELECT e.conv_id, count(*) FILTER (last IS NULL OR i < last OR (same AND i = last))::INTEGER AS n,
         coalesce(string_agg(t.head || t.body, '' ORDER BY i) FILTER (last IS NULL OR i < last OR (same AND i = last)), '') AS prompt
  FROM e JOIN t ON t.conv_id = e.conv_id GROUP BY e.conv_id)
SELECT conv_id, n AS n_prompt_turns, prompt,
       CASE WHEN last IS NULL OR same THEN '' ELSE head || body END AS chosen_text,
       CASE WHEN last IS NULL OR same THEN '' ELSE length(head) || ':' || length(head || body) END AS chosen_spans,
       CASE WHEN last IS NULL OR same OR stale IS NULL THEN '' ELSE head || stale END AS rejected_text,
       CASE WHEN last IS NULL OR same OR stale IS NULL THEN '' ELSE length(head) || ':' || length(head || stale) END AS rejected_spans
FROM e JOIN m USING (conv_id)
"""
