"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import in_arrow, materialize

K = 10
ONE = 1 << 29  # a cosine of 1 on the integer scale of the scores
BITS = (18, 6, 0)  # log2 of the bin width of each round of refinement
ROWS = 4096  # vectors of a block
EVERY = 20  # the registered query asks for the vectors whose id it divides
TASKS = 16  # of a round, for each core
STRIP = 128  # queries of a block whose scores are held at once


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Unit rows; null and non-finite numbers count as 0, shorter vectors are filled up, null vectors stay zero."""
    off = lists.offsets.to_numpy().astype(np.int64)
    off -= off[0]
    values = np.nan_to_num(lists.flatten().cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False), nan=0, posinf=0, neginf=0)
    size = np.diff(off)
    if len(size) and (size == dims).all():
        m = values.reshape(len(size), dims)
    else:
        m = np.zeros((len(size), dims))
        row = np.repeat(np.arange(len(size)), size)
        m[row, np.arange(len(values)) - np.repeat(off[:-1], size)] = values
    norm = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norm > 0, norm, 1)[:, None]


def _pairs(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.StructArray]]:
    """Query ids, integer scores (queries x corpus; own id below all), corpus ids and query rows, by strips of each block pair."""
    for i in range(batch.num_rows):
        q, c = batch.column("queries")[i].values, batch.column("corpus")[i].values
        ci, cm = c.field("id").to_numpy(zero_copy_only=False), _matrix(c.field("v"), dims).T
        for at in range(0, len(q), STRIP):  # a strip's scores are all that is held at once
            part = q.slice(at, STRIP)
            qi = part.field("id").to_numpy(zero_copy_only=False)
            s = np.rint(_matrix(part.field("v"), dims) @ cm * ONE).astype(np.int64) + ONE
            s[qi[:, None] == ci[None, :]] = -1
            yield qi, s, ci, part


def _histograms(k: int, bits: int, dims: int) -> Callable:
    """Counts by bin of the scores in each query's [lo, hi), from the top down to the bin where they reach k.

    A block's bins below its own k-th value can't hold the global k-th, so k bins a query and block are enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, s, _, q in _pairs(batch, dims):
                lo, hi = q.field("lo").to_numpy(), q.field("hi").to_numpy()
                row, col = np.nonzero((s >= lo[:, None]) & (s < hi[:, None]))
                b = (s[row, col] - lo[row]) >> bits
                n = int(b.max()) + 1 if len(b) else 1
                counts = np.bincount(row * n + b, minlength=len(qi) * n).reshape(len(qi), n)
                above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
                r, c = np.nonzero((counts > 0) & (above < k))
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(lo[r] + (c << bits)), pa.array(counts[r, c])], names=["id", "bin", "n"])

    return run


def _hits(dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, s, ci, q in _pairs(batch, dims):
                r, c = np.nonzero(s >= np.maximum(q.field("lo").to_numpy(), 0)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(ci[c]), pa.array(s[r, c])], names=["query_id", "vec_id", "s"])

    return run


def _grid(blocks: int, query_blocks: int, tasks: int) -> tuple[int, int]:
    """Partitions of the queries and of the corpus: about `tasks` pairs of them, whatever the number of blocks."""
    of_queries = max(1, min(query_blocks, round((tasks * query_blocks / blocks) ** 0.5)))
    return of_queries, max(1, min(blocks, -(-tasks // of_queries)))


def topk(vectors: DataFrame, k: int = K, rows: int = ROWS, queries: Column | None = None) -> DataFrame:
    """The k nearest other vectors by cosine, exactly, of every vector, or of those that meet `queries`, against all.

    Scores are cosines as integers (2**-29 apart).  Every round scores the queries against all vectors, adds up each
    query's histogram over the corpus, and narrows its interval to the bin that holds its k-th value, with bins of
    2**18, 2**6 and 1; it ends early when no such bin holds more than k.  A last pass keeps the scores from the
    interval on, and ranks by score, then smaller vec_id.  Scores are never stored or shuffled: of each pair of
    blocks come at most k bins a query, then the hits.  Blocks hold about `rows` vectors in the order of their ids, so
    a score comes out the same in every round.  Blocks of queries and of the corpus are dealt to a grid of partitions
    whose pairs are the tasks: these grow with the cores, not with the pairs of blocks.

    Result: query_id, rank (from 1), vec_id, score (6 decimals); ids are of any type that sorts.
    A query with fewer than k others gets them all.  Rows without id, or whose vector is null or empty, are left out;
    null and non-finite elements count as 0, a zero vector has cosine 0 with all, shorter vectors are filled up with
    zeros.  Of rows with one vec_id the largest vector counts.  An empty table gives an empty result.  Other columns
    are ignored, whatever their names, unless `queries` names them.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))).alias("asks"))
    id_type = v.schema["id"].dataType
    v = materialize(v.filter("id IS NOT NULL AND size(v) > 0").groupBy("id").agg(F.max("v").alias("v"), F.max("asks").alias("asks")), "vectors")
    size = v.agg(F.count("*").alias("n"), F.count_if("asks").alias("asks"), F.max(F.size("v")).alias("dims")).first()  # one row
    result = StructType([StructField("query_id", id_type), StructField("rank", IntegerType()), StructField("vec_id", id_type), StructField("score", DoubleType())])
    if not size.asks:
        return spark.createDataFrame([], result)
    blocks, query_blocks, dims = -(-size.n // rows), -(-size.asks // rows), size.dims
    of_queries, of_corpus = _grid(blocks, query_blocks, TASKS * spark.sparkContext.defaultParallelism)

    def packed(df: DataFrame, name: str, blocks: int, parts: int, *cols: str) -> DataFrame:
        by_block = df.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
        lists = by_block.agg(F.array_sort(F.collect_list(F.struct("id", "v", *cols))).alias(name))
        return lists.repartitionById(parts, F.expr(f"CAST(block % {parts} AS INT)")).select(name)

    asking, corpus = v.filter("asks").select("id", "v"), packed(v, "corpus", blocks, of_corpus)
    bounds = asking.select("id", F.lit(0).cast("long").alias("lo"), F.lit(2 * ONE + 1).cast("long").alias("hi"), F.lit(0).cast("long").alias("above"))
    found_bins = StructType([StructField("id", id_type), *StructType.fromDDL("bin bigint, n bigint").fields])
    for bits in BITS:
        pairs = packed(asking.join(bounds, "id"), "queries", query_blocks, of_queries, "lo", "hi").crossJoin(corpus)
        bins = in_arrow(pairs, _histograms(k, bits, dims), found_bins).groupBy("id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("id").orderBy(F.desc("bin"))
        bins = bins.join(bounds.select("id", "above"), "id").withColumn("upto", F.col("above") + F.sum("n").over(down))
        found = bins.filter(f"upto >= {k} AND upto - n < {k}").select(
            "id", F.col("bin").alias("lo"), F.expr(f"bin + {1 << bits}").alias("hi"), F.expr("upto - n").alias("above"), "n"
        )
        # a query with fewer than k others has no k-th value: it keeps its bounds
        kept = bounds.select("id", "lo", "hi", "above").withColumn("n", F.lit(0).cast("long")).join(found.select("id"), "id", "left_anti")
        bounds = materialize(found.unionByName(kept), "bounds")
        if bounds.filter(f"n > {k}").isEmpty():
            break
    hits = packed(asking.join(bounds.select("id", "lo"), "id"), "queries", query_blocks, of_queries, "lo").crossJoin(corpus)
    hits = in_arrow(hits, _hits(dims), StructType([StructField("query_id", id_type), StructField("vec_id", id_type), StructField("s", LongType())]))
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {k}")
    return ranked.select("query_id", "rank", "vec_id", F.round((F.col("s") - ONE) / ONE, 6).alias("score"))


SQL = f"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
), u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(round(list_inner_product(q.e, c.e) / (q.norm * c.norm) * {ONE}) AS BIGINT) AS s
  FROM u q JOIN u c ON q.vec_id <> c.vec_id AND q.vec_id % {EVERY} = 0
)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, round(s / {ONE}.0, 6) AS score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, vec_id)
QUALIFY row_number() OVER w <= {K}"""
