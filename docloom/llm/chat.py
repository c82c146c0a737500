"""Chat formatting: a dialogue rendered once from the side of each of its participants.

For a participant, its own turns become the assistant's, every other speaker is a user with a name, and system
turns stay system turns. The mask lists the spans of characters to train on: the participant's own turns with
their end marks. Only DataFrame functions are used. Positions come from running sums over the turns of a rendering,
so that the work grows with the number of turns. A rendering is one value of one row; where a conversation may be
larger than that (say, rows without an id that were gathered under null), ``max_turns`` renders it in parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM, NOBODY = "system", "unknown"
OPEN, OPENED, END = "<|", "< |", "<|end|>"


def rotate(turns: DataFrame, max_turns: int | None = None) -> DataFrame:
    """(conv_id, part, perspective, n_turns, n_chars, n_trained, text, mask) for each participant.

    ``turns``: conv_id, turn, role, text; other columns are ignored. Turns are ordered by number, ties by role
    and text, null numbers last; repeated rows are rendered each. A null text is empty and a null role is the
    speaker "unknown"; rows with a null conv_id form one conversation. Speakers whose role is "system" take no
    side, so a conversation of system turns alone gives no row. ``<|`` inside a text is written ``< |`` and can't
    be taken for a header. A conversation is rendered whole, as part 0; with ``max_turns``, ``part`` counts its runs of
    so many turns, and participants are still those of the whole conversation. ``mask`` holds ``start-end`` character
    positions (end exclusive), comma-separated. An empty table gives an empty table.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(NOBODY))
    body = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(OPEN), F.lit(OPENED))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), body.alias("body"))
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "body")
    at = F.row_number().over(place).cast("long") - 1
    placed = rows.select("conv_id", "role", "body", at.alias("at"))
    sides = rows.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("__conv"), F.col("role").alias("perspective")).distinct()
    each = placed.join(sides, F.col("conv_id").eqNullSafe(F.col("__conv")))
    own = F.col("role") == F.col("perspective")
    head = (
        F.when(F.col("role") == SYSTEM, F.lit("<|system|>\n"))
        .when(own, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), F.replace("role", F.lit(OPEN), F.lit(OPENED)), F.lit("|>\n")))
    )
    part = F.lit(0).cast("long") if max_turns is None else F.floor(F.col("at") / max_turns).cast("long")
    rendered = each.select("conv_id", part.alias("part"), "perspective", "at", own.alias("own"), head.alias("head"), F.concat("body", F.lit(END)).alias("said"))
    so_far = Window.partitionBy("conv_id", "part", "perspective").orderBy("at")
    end = F.sum(F.length("head") + F.length("said") + 1).over(so_far) - 1
    measured = rendered.withColumn("end", end).withColumn("start", F.col("end") - F.length("said"))
    span = F.when(F.col("own"), F.concat_ws("-", "start", "end"))
    told = F.sort_array(F.collect_list(F.struct("at", F.concat("head", "said", F.lit("\n")).alias("line"), span.alias("span"))))
    grouped = measured.groupBy("conv_id", "part", "perspective").agg(
        F.count("*").alias("n_turns"),
        (F.max("end") + 1).cast("long").alias("n_chars"),
        F.sum(F.when(F.col("own"), F.length("said")).otherwise(0)).cast("long").alias("n_trained"),
        told.alias("told"),
    )
    # joining an array skips its nulls
    return grouped.select("conv_id", "part", "perspective", "n_turns", "n_chars", "n_trained", F.array_join("told.line", "").alias("text"), F.array_join("told.span", ",").alias("mask"))


SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, body) - 1 AS pos FROM rows
), sides AS (
  SELECT DISTINCT conv_id, role AS perspective FROM rows WHERE role <> 'system'
), rendered AS (
  SELECT p.conv_id, pos, perspective, role = perspective AS own, body || '<|end|>' AS said,
         CASE WHEN role = 'system' THEN '<|system|>' || chr(10)
              WHEN role = perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || replace(role, '<|', '< |') || '|>' || chr(10) END AS head
  FROM placed p JOIN sides s ON p.conv_id IS NOT DISTINCT FROM s.conv_id
), measured AS (
  SELECT *, sum(length(head) + length(said) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY pos) - length(said) - 1 AS start
  FROM rendered
)
SELECT conv_id, 0::BIGINT AS part, perspective, count(*) AS n_turns,
       sum(length(head) + length(said) + 1)::BIGINT AS n_chars,
       sum(CASE WHEN own THEN length(said) ELSE 0 END)::BIGINT AS n_trained,
       string_agg(head || said || chr(10), '' ORDER BY pos) AS text,
       coalesce(string_agg(start::BIGINT || '-' || (start + length(said))::BIGINT, ',' ORDER BY pos) FILTER (WHERE own), '') AS mask
FROM measured GROUP BY conv_id, perspective
"""
