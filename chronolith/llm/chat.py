"""Chat formatting: conversations as training texts, by array expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def format_chats(turns: DataFrame, start: str = "<|", end: str = "|>", stop: str = "<|end|>") -> DataFrame:
    """One row a conversation: its turns in order, neighbours of one role merged, as one marked-up text.

    The turns of a conversation are collected once (one shuffle on conv_id), sorted as structs, cut where the role
    changes, and joined.  Run starts are found by a filter over positions and each run is one slice, so the work is
    linear in the turns, however long a conversation is.  `start`, `end` and `stop` delimit roles and messages; where a role or text holds
    `start` itself, a backslash is put behind its first character, so no text can forge a turn.

    Result: conv_id, n_turns (kept turns), n_messages (after merging), text.
    Rows without conv_id belong to no conversation and are left out.  A null turn sorts first; a null role counts as
    'unknown', a null text as empty.  Turns sort by turn, role, text, which settles ties.  Rows equal in all four
    columns are kept once, those with a null turn too.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    escaped = start[:1] + "\\" + start[1:]
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id",
        F.struct(
            F.col("turn").alias("n"),
            F.replace(F.coalesce("role", F.lit("unknown")), F.lit(start), F.lit(escaped)).alias("role"),
            F.replace(F.coalesce("text", F.lit("")), F.lit(start), F.lit(escaped)).alias("text"),
        ).alias("t"),
    )
    # nulls sort last in array_sort: the leading flag puts them first
    rows = rows.select("conv_id", F.struct(F.col("t.n").isNotNull().alias("has"), "t.n", "t.role", "t.text").alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))
    runs = chats.select(
        "conv_id",
        "turns",
        F.size("turns").alias("n_turns"),
        F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 OR turns[i].role <> turns[i - 1].role)").alias("starts"),
    )
    body = F.expr(
        "array_join(transform(starts, (s, j) -> concat(lb, turns[s].role, rb, '\\n', array_join(transform("
        "slice(turns, s + 1, coalesce(get(starts, j + 1), n_turns) - s), x -> x.text), '\\n'), ls)), '\\n')"
    )
    return runs.withColumns({"lb": F.lit(start), "rb": F.lit(end), "ls": F.lit(stop)}).select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.size("starts").cast("long").alias("n_messages"), body.alias("text")
    )


SQL = r"""
WITH d AS (
  SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '<\|') AS role, replace(coalesce(text, ''), '<|', '<\|') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER w AS i,
         CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS first
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), r AS (
  SELECT *, sum(first) OVER (PARTITION BY conv_id ORDER BY i) AS run FROM o
), m AS (
  SELECT conv_id, run, count(*) AS n,
         '<|' || min(role) || '|>' || chr(10) || string_agg(text, chr(10) ORDER BY i) || '<|end|>' AS message
  FROM r GROUP BY conv_id, run
)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_turns, count(*) AS n_messages,
       string_agg(message, chr(10) ORDER BY run) AS text
FROM m GROUP BY conv_id"""
