"""Packing by power-of-two decomposition: every training sequence is a run of tokens of one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokens

MAX_LOG2 = 13


def pack(docs: DataFrame, max_log2: int = MAX_LOG2) -> DataFrame:
    """Split each document into pieces of 2**k tokens, longest first, and bucket them by k.

    A document of n tokens gives n // 2**max_log2 pieces of the largest length, and below that one piece for each
    bit of the rest.  Pieces of a bucket have equal length, so batches need no padding, no cut across documents and
    no attention mask.  Tokens are runs of non-blank characters, joined by one space in `text`.

    One narrow pass: no shuffle, and a skewed source changes nothing.

    Result: doc_id, bucket (k), start (first token), n_tokens (2**k), text.
    Null, empty and blank texts give no piece.  A null doc_id is kept as null.  Repeated rows are packed each for
    itself.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    top = 1 << max_log2
    d = docs.select("doc_id", tokens("text").alias("t")).withColumn("n", F.size("t")).filter("n > 0")
    cuts = F.expr(f"""concat(
        transform(filter(sequence(0, n div {top}), i -> i < n div {top}),
                  i -> named_struct('k', {max_log2}, 's', i * {top})),
        transform(filter(sequence({max_log2} - 1, 0, -1), k -> (n & shiftleft(1, k)) <> 0),
                  k -> named_struct('k', k, 's', shiftleft(shiftright(n, k + 1), k + 1))))""")
    return d.select("doc_id", "t", F.explode(cuts).alias("c")).select(
        "doc_id",
        F.col("c.k").cast("int").alias("bucket"),
        F.col("c.s").cast("long").alias("start"),
        F.expr("shiftleft(1L, c.k)").alias("n_tokens"),
        F.expr("array_join(slice(t, c.s + 1, shiftleft(1, c.k)), ' ')").alias("text"),
    )


SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS t
  FROM documents WHERE text IS NOT NULL
), n AS (
  SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0
), p AS (
  SELECT doc_id, t, {MAX_LOG2} AS k, unnest(range(n // {1 << MAX_LOG2})) * {1 << MAX_LOG2} AS s FROM n
  UNION ALL
  SELECT doc_id, t, k, ((n >> (k + 1)) << (k + 1)) AS s
  FROM n, (SELECT unnest(range({MAX_LOG2})) AS k) WHERE (n >> k) & 1 = 1
)
SELECT doc_id, CAST(k AS INT) AS bucket, CAST(s AS BIGINT) AS start, CAST(1 << k AS BIGINT) AS n_tokens,
       array_to_string(list_slice(t, s + 1, s + (1 << k)), ' ') AS text
FROM p"""
