"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant, the others as
named users, system turns as they are, and a mask that trains only on the speaker's own turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, small_side, written

#: A rendering goes up to so many turns; a longer conversation goes on in further blocks, so that one of any length is
#: never gathered in one task.
BLOCK_TURNS = 4096
#: Longer conversations than a block are broadcast by id up to this number; more are joined by shuffle.
BROADCAST_LONG = 500_000
SYSTEM = "system"
#: The markers of a rendered turn.
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
_ORDER = ("late", "turn", "nameless", "role", "text")


def _clean(text: Column) -> Column:
    """Texts and names can't forge the markers."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per conversation, participant and block of block_turns turns: conv_id, speaker, block, n_turns, rendered, mask,
    n_chars, n_trained.

    turns: conv_id, turn, role, text; further columns are ignored. Participants are the roles but the system; turns whose
    role is null or blank are a nameless user's, who is nobody else, and get no perspective. Turns are ordered by number
    (null last), then role (nameless last), then text; null texts are empty; repeated rows stay. Blocks count from 0 in that
    order; up to block_turns turns there is one. Texts of any length stay whole. Markers in texts and names are broken, line
    ends in names are blanks. mask has a 1 for each turn of the speaker, a 0 for each other one; n_trained counts the
    characters of the speaker's texts as rendered. Conversations with a null id form one. Without participants there is no
    row; an empty table gives none.
    """
    role = F.when(F.trim("role") != "", F.col("role"))
    said = turns.select(
        "conv_id", F.col("turn").isNull().alias("late"), "turn", role.isNull().alias("nameless"), role.alias("role"),
        _clean(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
    )
    counts = written(said.groupBy("conv_id").agg(F.count("*").alias("n")))
    of = lambda df: df.select(F.col("conv_id").alias("_of"), *(c for c in df.columns if c != "conv_id"))
    here = F.col("conv_id").eqNullSafe(F.col("_of"))
    long = counts.filter(F.col("n") > block_turns).select("conv_id")
    blocked = said.withColumn("block", F.lit(0).cast("long"))
    if not long.isEmpty():
        long = small_side(long, BROADCAST_LONG)
        placed = numbered(said.join(of(long), here, "left_semi"), ["conv_id"], _ORDER).withColumn("block", F.floor(F.col("_place") / block_turns).cast("long"))
        blocked = blocked.join(of(long), here, "left_anti").unionByName(placed.drop("_place"))
    blocks = blocked.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct(*_ORDER))).alias("said"))

    speakers = said.filter(~F.col("nameless") & (F.col("role") != SYSTEM)).select("conv_id", F.col("role").alias("speaker")).distinct()
    last = F.floor((F.col("n") - 1) / block_turns).cast("long")
    speakers = speakers.join(of(counts), here).select(F.col("conv_id").alias("_conv"), "speaker", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_block"))

    own = lambda s: F.coalesce(s.role == F.col("speaker"), F.lit(False))
    name = lambda s: F.translate(_clean(s.role), "\n\r", "  ")
    head = lambda s: F.when(own(s), "assistant").when(s.nameless, "user").when(s.role == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), name(s)))
    render = lambda s: F.concat(F.lit(OPEN), head(s), F.lit("\n"), s.text, F.lit(CLOSE))
    views = blocks.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    return views.select(
        "conv_id", "speaker", "block", F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", render), "").alias("rendered"),
        F.array_join(F.transform("said", lambda s: F.when(own(s), "1").otherwise("0")), "").alias("mask"),
        F.aggregate(F.transform("said", lambda s: F.when(own(s), F.length(s.text)).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_trained"),
    ).withColumn("n_chars", F.length("rendered").cast("long"))


_IN_ORDER = "ORDER BY turn NULLS LAST, role NULLS LAST, text"
ROTATE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, CASE WHEN trim(role) <> '' THEN role END AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id {_IN_ORDER}) - 1) // {BLOCK_TURNS} AS block FROM c),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM c WHERE role <> '{SYSTEM}'),
v AS (SELECT t.*, s.speaker, coalesce(t.role = s.speaker, false) AS own,
             CASE WHEN t.role = s.speaker THEN 'assistant' WHEN t.role IS NULL THEN 'user' WHEN t.role = '{SYSTEM}' THEN t.role
                  ELSE 'user name=' || translate(replace(t.role, '<|', '< |'), chr(10) || chr(13), '  ') END AS head
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id)
SELECT conv_id, speaker, block, count(*) AS n_turns,
       string_agg('{OPEN}' || head || chr(10) || text || '{CLOSE.strip()}' || chr(10), '' {_IN_ORDER}) AS rendered,
       string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' {_IN_ORDER}) AS mask,
       CAST(sum(CASE WHEN own THEN length(text) ELSE 0 END) AS BIGINT) AS n_trained,
       CAST(sum(length('{OPEN}' || head || text || '{CLOSE.strip()}') + 2) AS BIGINT) AS n_chars
FROM v GROUP BY conv_id, speaker, block
"""
