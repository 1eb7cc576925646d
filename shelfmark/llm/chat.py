"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once with that
speaker as ``assistant`` and every other speaker as a named ``user``; roles listed in
``context_roles`` (``system``) stay what they are and are nobody's perspective. ``spans``
marks, in characters of ``rendered``, what the speaker wrote with its end marker: the part
that a training loss would count.

A dialogue is rendered whole up to ``part_turns`` turn numbers; a longer one is cut into parts of that many, so a
conversation that holds a third of all turns never meets in one task. The parts of one perspective, joined in order of
``part``, are its dialogue.

Defined cases: rows that repeat exactly (same conversation, turn, role and text) are one
message; messages of the same turn follow by role, then text; a null turn sorts last, in a
part of its own (null); a null role speaks as ``unknown``; a null text is empty; null
conversation ids form one conversation; a conversation of context roles only has no
perspective and no rows; markers inside a text or a role are broken by a space and line ends in a role become
spaces, so that neither can pose as a marker or a turn (roles that look alike after that are one speaker). Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, PART_TURNS = "<|im_start|>", "<|im_end|>", 1024


def _safe(text):
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def rotate_perspectives(conversations: DataFrame, context_roles: tuple[str, ...] = ("system",), part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation, part and perspective: conv_id, part, speaker, n_messages, rendered,
    spans array<struct<start int, end int>> (end exclusive)."""
    rows = conversations.select(
        F.col("conv_id").alias("conv_id"),
        F.floor(F.col("turn") / part_turns).cast("long").alias("part"),
        F.struct(
            F.col("turn").isNull().alias("late"),
            F.col("turn").alias("turn"),
            _safe(F.translate(F.coalesce(F.col("role"), F.lit("unknown")), "\n\r", "  ")).alias("role"),
            _safe(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
        ).alias("m"),
    )
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_set("m")).alias("ms"))
    context = F.array(*(F.lit(r) for r in context_roles)).cast("array<string>")
    own = parts.withColumn("who", F.array_except(F.transform("ms", lambda m: m["role"]), context))
    # The speakers of a conversation are those of all its parts; a part is a bounded number of rows.
    speakers = own.select("conv_id", F.explode("who").alias("speaker")).distinct().withColumnRenamed("conv_id", "of")
    return parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "part", "speaker", *_render(context))


def _render(context):
    speaker = F.col("speaker")

    def head(m):
        role = m["role"]
        return F.when(role == speaker, F.lit("assistant")).when(F.array_contains(context, role), role).otherwise(F.concat(F.lit("user name="), role))

    pieces = F.transform("ms", lambda m: F.struct((m["role"] == speaker).alias("mine"), F.concat(F.lit(OPEN), head(m), F.lit("\n")).alias("head"), F.concat(m["text"], F.lit(CLOSE)).alias("body")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        spans = F.when(p["mine"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return [
        F.size("ms").cast("long").alias("n_messages"),
        F.concat(F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"])), "\n"), F.lit("\n")).alias("rendered"),
        F.aggregate(pieces, start, step, lambda acc: acc["spans"]).alias("spans"),
    ]


#: The same rows in DuckDB, written from the rules above; spans as text ``start-end`` joined by commas.
ORACLE_SQL = """
WITH msg AS (
  SELECT DISTINCT conv_id, CAST(floor(turn / 1024.0) AS BIGINT) AS part, turn, replace(translate(coalesce(role, 'unknown'), chr(10) || chr(13), '  '), '<|im_', '<| im_') AS role,
         replace(coalesce(text, ''), '<|im_', '<| im_') AS text
  FROM conversations
), who AS (SELECT DISTINCT conv_id, role AS speaker FROM msg WHERE role <> 'system'),
line AS (
  SELECT m.conv_id, m.part, w.speaker, m.turn, m.role, m.text, m.role = w.speaker AS mine,
         '<|im_start|>' || CASE WHEN m.role = w.speaker THEN 'assistant' WHEN m.role = 'system' THEN 'system' ELSE 'user name=' || m.role END || chr(10) AS head,
         m.text || '<|im_end|>' AS body
  FROM msg m JOIN who w ON m.conv_id IS NOT DISTINCT FROM w.conv_id
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, speaker ORDER BY turn NULLS LAST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs
  FROM line
)
SELECT conv_id, part, speaker, CAST(count(*) AS BIGINT) AS n_messages,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS rendered,
       coalesce(string_agg(CAST(CAST(offs + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(offs + length(head) + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY offs) FILTER (WHERE mine), '') AS mask
FROM placed GROUP BY conv_id, part, speaker
"""
