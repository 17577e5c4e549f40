"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant
and everybody else as a named user. The mask covers the assistant's words only, as character spans of the
rendered text. Speakers in ``narrators`` (system messages) never take part: they keep their own role.

Dialogues are cut into chunks of ``turns`` consecutive turn numbers, so a conversation with very many
turns becomes many rows and is never gathered in one place.

Defined results: turns are ordered by number, then role, then text, nulls first; exactly repeated rows
count once; a null or empty text is an empty message; a null role is a user without a name and has no
perspective of its own; a conversation with narrators only has no perspective; rows without a conversation
or a turn number have no place in a dialogue and are left out; texts may have any length; an empty table gives
an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = 256
NARRATORS = ("system",)
START, END = "<|im_start|>", "<|im_end|>"


def rotate(
    conversations: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    turns: int = TURNS,
    narrators: tuple[str, ...] = NARRATORS,
) -> DataFrame:
    """One row per conversation, chunk and perspective: the rendered text and its trainable spans.

    Columns: conv_id, chunk, perspective, n_turns, n_masked (assistant turns), text, mask (array of
    (start, end) code point offsets of the assistant's words).
    """
    rows = (
        conversations.select(
            F.col(conversation).alias("conv_id"),
            F.col(turn).cast("long").alias("turn"),
            F.col(speaker).alias("role"),
            F.col(text).alias("text"),
        )
        .filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
        .distinct()
    )
    chunks = rows.groupBy("conv_id", F.floor(F.col("turn") / turns).cast("long").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns")
    )
    people = (
        rows.filter(F.col("role").isNotNull() & ~F.col("role").isin(*narrators))
        .select("conv_id", F.col("role").alias("perspective"))
        .distinct()
    )
    spoken = chunks.join(people, "conv_id")

    def mine(t: Column) -> Column:
        return F.coalesce(t["role"] == F.col("perspective"), F.lit(False))

    def opening(t: Column) -> Column:
        return F.concat(
            F.lit(START),
            F.when(mine(t), F.lit("assistant"))
            .when(t["role"].isin(*narrators), t["role"])
            .when(t["role"].isNotNull(), F.concat(F.lit("user name="), t["role"]))
            .otherwise(F.lit("user")),
            F.lit("\n"),
        )

    def words(t: Column) -> Column:
        return F.coalesce(t["text"], F.lit(""))

    messages = F.transform(
        "_turns",
        lambda t: F.struct(
            opening(t).alias("open"), words(t).alias("words"), mine(t).alias("mine")
        ),
    )
    closing = f"{END}\n"
    size = lambda m: F.length(m["open"]) + F.length(m["words"]) + len(closing)
    state = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    )

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["open"])
        span = F.struct(start.alias("start"), (start + F.length(m["words"])).alias("end"))
        return F.struct(
            (acc["at"] + size(m)).alias("at"),
            F.when(m["mine"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return spoken.withColumn("_messages", messages).select(
        "conv_id",
        "chunk",
        "perspective",
        F.size("_turns").alias("n_turns"),
        F.size(F.filter("_messages", lambda m: m["mine"])).alias("n_masked"),
        F.array_join(
            F.transform("_messages", lambda m: F.concat(m["open"], m["words"], F.lit(closing))), ""
        ).alias("text"),
        F.aggregate("_messages", state, step)["spans"].alias("mask"),
    )


def report(rendered: DataFrame) -> DataFrame:
    """The rendered dialogues with their mask as text, ``start-end`` joined by commas."""
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return rendered.withColumn("mask", F.array_join(spans, ","))


SQL = f"""
WITH turns AS (
  SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), people AS (
  SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role IS NOT NULL AND role <> 'system'
), said AS (
  SELECT conv_id, CAST(floor(turn / {TURNS}.0) AS BIGINT) AS chunk, perspective, turn, role, text AS original,
         coalesce(role = perspective, FALSE) AS mine,
         '{START}' || CASE WHEN coalesce(role = perspective, FALSE) THEN 'assistant' WHEN role = 'system' THEN role
           WHEN role IS NOT NULL THEN 'user name=' || role ELSE 'user' END || chr(10) AS opening,
         coalesce(text, '') AS words
  FROM turns JOIN people USING (conv_id)
), placed AS (
  SELECT *, CAST(sum(length(opening) + length(words) + {len(END) + 1}) OVER (
      PARTITION BY conv_id, chunk, perspective
      ORDER BY turn, role NULLS FIRST, original NULLS FIRST ROWS UNBOUNDED PRECEDING
    ) AS BIGINT) - length(words) - {len(END) + 1} AS start_at
  FROM said
)
SELECT conv_id, chunk, perspective, CAST(count(*) AS INTEGER) AS n_turns,
       CAST(count(*) FILTER (WHERE mine) AS INTEGER) AS n_masked,
       string_agg(opening || words || '{END}' || chr(10), '' ORDER BY turn, role NULLS FIRST, original NULLS FIRST)
         AS text,
       coalesce(string_agg(start_at || '-' || (start_at + length(words)), ',' ORDER BY turn, original NULLS FIRST)
         FILTER (WHERE mine), '') AS mask
FROM placed GROUP BY conv_id, chunk, perspective
"""
