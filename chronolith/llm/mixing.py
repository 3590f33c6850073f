"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, running_sum, tokens

BLOCK = 16384  # tokens of a block
ALPHA = 0.7  # a source's target weight is its token share to this power
SCALE = 1 << 20  # weights are integers on about this scale
GOLDEN = 2654435769  # 2**32 / golden ratio, odd
CHUNK = 65536  # slots ranked together


def _sources(rows: DataFrame, block: int, alpha: float, weights: DataFrame | None) -> DataFrame:
    """Blocks and the interval [lo, hi) of each source on the integer scale of the weights, one row a source."""
    s = rows.groupBy("source").agg(F.sum("n").cast("long").alias("n"))
    total = Window.partitionBy()
    if weights is None:
        share = F.pow(F.col("n") / F.sum("n").over(total), F.lit(alpha))
        s = s.select("source", "n", F.greatest(F.lit(1), F.round(share * SCALE)).cast("long").alias("w"))
    else:
        told = weights.select(F.coalesce("source", F.lit("")).alias("source"), F.col("weight").cast("double").alias("v")).filter("v > 0")
        s = s.join(told.groupBy("source").agg(F.max("v").alias("v")), "source", "left")
        s = s.withColumn("v", F.coalesce("v", F.col("n") / F.sum("n").over(total) * F.coalesce(F.sum("v").over(total), F.lit(1.0))))
        s = s.select("source", "n", F.greatest(F.lit(1), F.round(F.col("v") / F.sum("v").over(total) * SCALE)).cast("long").alias("w"))
    run = Window.orderBy("source")
    return s.select(
        "source",
        F.ceil(F.col("n") / block).cast("long").alias("blocks"),
        "w",
        (F.sum("w").over(run) - F.col("w")).alias("lo"),
        F.sum("w").over(run).alias("hi"),
        F.sum("w").over(total).alias("all_w"),
    )


def schedule(sources: DataFrame, slots: int | None = None) -> DataFrame:
    """slot, source, block: golden-ratio points mapped through the cumulative weights, ranked within their source.

    Without `slots` the schedule is the shortest that uses each block of each source at least once.
    """
    spark = sources.sparkSession
    need = F.ceil((F.col("blocks") + 64) * F.col("all_w") / F.col("w"))
    last = sources.agg(F.max(need).alias("n"), F.max("all_w").alias("w")).first()  # one row
    if last.n is None:
        return sources.select(F.lit(0).cast("long").alias("slot"), "source", F.lit(0).cast("long").alias("block")).limit(0)
    n = int(last.n) if slots is None else slots
    width = max(1, math.ceil(int(last.w) / 4096))
    # slot * GOLDEN modulo 2**32 in two halves, so that no product is too large; the points repeat after 2**32 slots
    high = F.expr(f"((shiftright(slot, 16) & 65535L) * {GOLDEN} & 65535L) * 65536L + (slot & 65535L) * {GOLDEN}")
    point = F.shiftright(high.bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(int(last.w)), 32)
    s = spark.range(n).select(F.col("id").alias("slot")).withColumn("v", point).withColumn("cell", F.expr(f"v div {width}"))
    # range join: the weight axis in 4096 cells, each source in the cells that it covers
    cells = sources.withColumn("cell", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    s = s.join(cells, "cell").filter("lo <= v AND v < hi").select("slot", "source", "blocks")
    s = running_sum(s, ["source"], F.expr(f"slot div {CHUNK}"), [F.col("slot")], F.lit(1), "rank")
    if slots is None:
        s = s.crossJoin(F.broadcast(s.filter("rank = blocks - 1").agg(F.max("slot").alias("final")))).filter("slot <= final")
    return s.select("slot", "source", F.expr("rank % blocks").alias("block"))


def _order(seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n").cast("string")))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    block: int = BLOCK,
    alpha: float = ALPHA,
    slots: int | None = None,
    seed: str = "mix",
    keep: list[str] | None = None,
    names: list[str] | None = None,
) -> DataFrame:
    """Put the sources' tokens in an order that holds the target weights in every stretch of it.

    Within a source the documents are shuffled by a seeded hash and cut into blocks of `block` tokens (the last may be
    shorter).  Slot i of the schedule goes to the source in whose interval of the cumulative weights the i-th
    golden-ratio point falls; the slot's rank within its source picks the block, around again when all are used.
    `weights` (source, weight) sets targets; a source that it doesn't list, or not with a weight above 0, gets its token
    share of their sum (of a source's weights the largest counts).  Without it targets are the token shares to the
    power `alpha`, which raises small sources.  Without `slots` the schedule ends as soon as every block has been used, so no token is lost.

    Positions come from prefix sums over hash buckets, so a hot source is many tasks.  Texts are read once to count
    their tokens (the counts are written), and once more and shuffled to join the finished assignments.

    Result: slot, source, block, doc_id, start (token of the document), n_tokens, text; with `keep`, also `whole` (the
    part is its whole document) and these columns of the document under the `names` given for them.
    A part that holds its whole document has the text as it was; else its tokens joined by one space.
    A null source counts as the source ''.  Null, empty and blank texts have no token and appear nowhere.  A null
    doc_id is a value like any other.  Rows that agree in doc_id, source and token count take one place in the order,
    and all of them are put out there.  Texts of any length are cut into as many blocks as they fill.  An empty table gives an empty result.  Other
    columns are ignored.
    """
    keep = keep or []
    n = F.size(tokens("text")).cast("long").alias("n")
    source = F.coalesce(F.col("source"), F.lit("")).alias("source")
    rows = materialize(docs.select("doc_id", source, n).filter("n > 0").distinct(), "counts")
    sources = materialize(_sources(rows, block, alpha, weights), "sources")
    at = running_sum(rows.withColumn("key", _order(seed)), ["source"], F.substring("key", 1, 3), [F.col("key")], F.col("n"), "at")
    parts = (
        at.withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + n - 1) div {block})")))
        .withColumn("from", F.expr(f"greatest(0L, block * {block} - at)"))
        .withColumn("take", F.expr(f"least(n, (block + 1) * {block} - at)") - F.col("from"))
    )
    plan = parts.join(schedule(sources, slots), ["source", "block"]).select(
        "slot", "block", "from", "take", F.col("source").alias("s_"), F.col("doc_id").alias("d_"), F.col("n").alias("n_")
    )
    texts = docs.select("doc_id", source, n, "text", *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]).filter("n > 0")
    on = F.col("d_").eqNullSafe(F.col("doc_id")) & (F.col("s_") == F.col("source")) & (F.col("n_") == F.col("n"))
    part = F.array_join(F.slice(tokens("text"), (F.col("from") + 1).cast("int"), F.col("take").cast("int")), " ")
    return texts.join(plan, on).select(
        "slot",
        "source",
        "block",
        "doc_id",
        F.col("from").alias("start"),
        F.col("take").alias("n_tokens"),
        F.when(F.col("take") == F.col("n"), F.col("text")).otherwise(part).alias("text"),
        *([(F.col("take") == F.col("n")).alias("whole")] if keep else []),
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(names or keep)],
    )


SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS source, text,
         list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS t
  FROM documents WHERE text IS NOT NULL
), d AS (SELECT DISTINCT doc_id, source, CAST(len(t) AS BIGINT) AS n FROM t WHERE len(t) > 0),
a AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || n)
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d
), p AS (
  SELECT *, unnest(range(CAST(pos AS BIGINT) // {BLOCK}, CAST(pos + n - 1 AS BIGINT) // {BLOCK} + 1)) AS block FROM a
), q AS (
  SELECT *, greatest(0, block * {BLOCK} - pos) AS f, least(n, (block + 1) * {BLOCK} - pos) - greatest(0, block * {BLOCK} - pos) AS take FROM p
), s0 AS (SELECT source, sum(n) AS n FROM d GROUP BY source),
s1 AS (
  SELECT source, CAST(ceil(n / {BLOCK}.0) AS BIGINT) AS blocks,
         CAST(greatest(1, round(pow(n / CAST(sum(n) OVER () AS DOUBLE), {ALPHA}) * {SCALE})) AS BIGINT) AS w FROM s0
), s AS (
  SELECT *, CAST(sum(w) OVER (ORDER BY source) AS BIGINT) AS hi, CAST(sum(w) OVER () AS BIGINT) AS all_w FROM s1
), slots AS (
  SELECT i AS slot, ((i * {GOLDEN}) % 4294967296 * (SELECT max(all_w) FROM s)) >> 32 AS v
  FROM range((SELECT CAST(max(ceil((blocks + 64) * all_w / CAST(w AS DOUBLE))) AS BIGINT) FROM s)) r(i)
), ranked AS (
  SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM slots JOIN s ON hi - w <= v AND v < hi
), sched AS (
  SELECT slot, source, rank % blocks AS block FROM ranked
  WHERE slot <= (SELECT max(slot) FROM ranked WHERE rank = blocks - 1)
)
SELECT CAST(slot AS BIGINT) AS slot, q.source, CAST(block AS BIGINT) AS block, q.doc_id, CAST(f AS BIGINT) AS start,
       CAST(take AS BIGINT) AS n_tokens,
       CASE WHEN take = q.n THEN text ELSE array_to_string(list_slice(t, CAST(f AS BIGINT) + 1, CAST(f + take AS BIGINT)), ' ') END AS text
FROM q JOIN sched USING (source, block)
JOIN t ON t.doc_id IS NOT DISTINCT FROM q.doc_id AND t.source = q.source AND len(t.t) = q.n"""
