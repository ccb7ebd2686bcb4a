"""Operator 10: preference formatting of chosen and rejected conversations.

The longest common turn prefix of the two is rendered once as the prompt; what follows it in each is rendered
as a completion whose loss mask covers the assistant's words only. A pair is one record.

Turns meet as rows: the end of the common prefix is a minimum over turns, and only then are the rendered turns of a
pair put together, in the order of their numbers, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import checkpointed
from tessera.session import table

ASSISTANT = "assistant"


def clean_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text``: one row per conversation and turn number."""
    rows = conversations.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).where("conv IS NOT NULL AND turn IS NOT NULL")
    return rows.groupBy("conv", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv", "turn", "m.role", "m.text")


def swapped_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, pairs) for conversations (integer ids) without preference marks: each is cut behind its last reply of the
    assistant and is chosen over itself with another reply in that place.

    The other reply is the last one of the conversation whose id differs in the lowest bit; where there is none, or
    it is the same text, the conversation's own first reply; where that is the same too, there is no pair. The
    rejected conversations are numbered -1 - id.
    """
    said = F.col("role") == ASSISTANT
    replies = turns.where(said).groupBy("conv").agg(F.max_by("text", "turn").alias("last"), F.min_by("text", "turn").alias("first"), F.max("turn").alias("cut"))
    replies = checkpointed(replies)
    theirs = replies.select(F.col("conv").bitwiseXOR(F.lit(1)).alias("conv"), F.col("last").alias("theirs"))
    other = F.when(F.col("theirs") != F.col("last"), F.col("theirs")).when(F.col("first") != F.col("last"), F.col("first"))
    swaps = replies.join(theirs, "conv", "left").select("conv", "cut", other.alias("other")).where("other IS NOT NULL")
    cut = turns.join(swaps, "conv").where("turn <= cut")
    rejected = cut.select((-1 - F.col("conv")).alias("conv"), "turn", "role", F.when(F.col("turn") == F.col("cut"), F.col("other")).otherwise(F.col("text")).alias("text"))
    pairs = swaps.select(F.col("conv").alias("chosen"), (-1 - F.col("conv")).alias("rejected"))
    return cut.select("conv", "turn", "role", "text").unionByName(rejected), pairs


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_preferences(
    conversations: DataFrame,
    pairs: DataFrame | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One record per pair: ``chosen``, ``rejected`` (ids), ``prompt_turns``, ``prompt``, ``chosen_text``, ``chosen_mask``,
    ``rejected_text``, ``rejected_mask``.

    ``pairs`` (``chosen``, ``rejected``: conversation ids; repeated pairs count once) defaults to ``swapped_replies``. Turns
    are aligned by number; the prompt ends before the first number at which role or text differ or one side has no
    turn, and a side that ends there has an empty text. The masks list the character spans ``begin:end`` of the
    assistant's words in each completion, joined by commas; nothing of the prompt is learnt. Pairs without any
    difference are no preference and are left out, and so are pairs of conversations without turns.

    Null roles and texts count as empty. Rows without conversation or turn number are left out. Rows that repeat
    a turn number count once (the first by role and text). Texts are rendered whole; other columns are ignored;
    an empty table gives an empty result.
    """
    turns = checkpointed(clean_turns(conversations, conv_col, turn_col, role_col, text_col))
    if pairs is None:
        turns, pairs = swapped_replies(turns)
    pairs = checkpointed(pairs.select("chosen", "rejected").distinct())
    sides = [
        pairs.join(turns, pairs[side] == turns["conv"]).select("chosen", "rejected", F.lit(side).alias("side"), "turn", "role", "text")
        for side in ("chosen", "rejected")
    ]
    rows = checkpointed(sides[0].unionByName(sides[1]))
    digest = F.sha2(F.concat_ws("\n", "role", "text"), 256)
    one = {s: F.max(F.when(F.col("side") == s, digest)) for s in ("chosen", "rejected")}
    split = (
        rows.groupBy("chosen", "rejected", "turn")
        .agg((~one["chosen"].eqNullSafe(one["rejected"])).alias("differs"))
        .where("differs")
        .groupBy("chosen", "rejected")
        .agg(F.min("turn").alias("split"))
    )
    shared = F.col("turn") < F.col("split")
    placed = (
        rows.join(split, ["chosen", "rejected"])
        .where(~shared | (F.col("side") == "chosen"))
        .withColumn("part", F.when(shared, "prompt").otherwise(F.col("side")))
        .withColumn("rendered", _rendered(F.col("role"), F.col("text")))
        .withColumn("head", F.when((F.col("role") == ASSISTANT) & ~shared, F.length("role") + 5))
    )
    turn = F.struct("turn", "rendered", "head", (F.length("rendered") - 8).alias("tail"), F.length("rendered").alias("size"))
    of = {p: F.array_sort(F.collect_list(F.when(F.col("part") == p, turn))).alias(p) for p in ("prompt", "chosen", "rejected")}
    grouped = placed.groupBy(F.col("chosen").alias("c"), F.col("rejected").alias("r")).agg(*of.values())  # the turns of one record

    def text(part: str) -> Column:
        return F.array_join(F.transform(part, lambda t: t["rendered"]), "")

    def mask(part: str) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
        span = lambda s, t: F.concat_ws(":", s["at"] + t["head"], s["at"] + t["tail"])
        walk = lambda s, t: F.struct((s["at"] + t["size"]).alias("at"), F.when(t["head"].isNull(), s["spans"]).otherwise(F.concat(s["spans"], F.array(span(s, t)))).alias("spans"))
        return F.array_join(F.aggregate(part, zero, walk)["spans"], ",")

    return grouped.select(
        F.col("c").alias("chosen"), F.col("r").alias("rejected"), F.size("prompt").alias("prompt_turns"), text("prompt").alias("prompt"),
        text("chosen").alias("chosen_text"), mask("chosen").alias("chosen_mask"), text("rejected").alias("rejected_text"), mask("rejected").alias("rejected_mask"),
    )


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(table(spark, sf_dir, "conversations"))


OP10_SQL = """
WITH t AS (
    SELECT conv_id AS conv, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS m
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
turns AS (SELECT conv, turn, m.role AS role, m.text AS text FROM t),
replies AS (
    SELECT conv, arg_max(text, turn) AS last, arg_min(text, turn) AS first, max(turn) AS cut
    FROM turns WHERE role = 'assistant' GROUP BY conv),
swaps AS (
    SELECT a.conv, a.cut, CASE WHEN b.last <> a.last THEN b.last WHEN a.first <> a.last THEN a.first END AS other
    FROM replies a LEFT JOIN replies b ON b.conv = xor(a.conv, 1)),
own AS (SELECT turns.*, cut, other FROM turns JOIN swaps USING (conv) WHERE turn <= cut AND other IS NOT NULL),
rows AS (
    SELECT conv AS chosen, 'chosen' AS side, turn, role, text FROM own
    UNION ALL SELECT conv, 'rejected', turn, role, CASE WHEN turn = cut THEN other ELSE text END FROM own),
split AS (
    SELECT chosen, min(turn) AS split FROM (
        SELECT chosen, turn FROM rows GROUP BY chosen, turn
        HAVING count(*) < 2 OR count(DISTINCT concat(role, chr(10), text)) > 1)
    GROUP BY 1),
placed AS (
    SELECT chosen, CASE WHEN turn < split THEN 'prompt' ELSE side END AS part,
           turn, role, concat('<|', role, '|>', chr(10), text, '<|end|>', chr(10)) AS rendered
    FROM rows JOIN split USING (chosen) WHERE turn >= split OR side = 'chosen'),
offsets AS (
    SELECT *, sum(length(rendered)) OVER (PARTITION BY chosen, part ORDER BY turn) - length(rendered) AS start
    FROM placed),
parts AS (
    SELECT chosen, part, count(*) AS n, string_agg(rendered, '' ORDER BY turn) AS text,
           coalesce(string_agg(concat(start + length(role) + 5, ':', start + length(rendered) - 8), ',' ORDER BY turn)
                    FILTER (WHERE role = 'assistant'), '') AS mask
    FROM offsets GROUP BY 1, 2)
SELECT chosen, -1 - chosen AS rejected,
       coalesce(max(n) FILTER (WHERE part = 'prompt'), 0)::INTEGER AS prompt_turns,
       coalesce(max(text) FILTER (WHERE part = 'prompt'), '') AS prompt,
       coalesce(max(text) FILTER (WHERE part = 'chosen'), '') AS chosen_text,
       coalesce(max(mask) FILTER (WHERE part = 'chosen'), '') AS chosen_mask,
       coalesce(max(text) FILTER (WHERE part = 'rejected'), '') AS rejected_text,
       coalesce(max(mask) FILTER (WHERE part = 'rejected'), '') AS rejected_mask
FROM parts GROUP BY chosen"""
