"""Rows that may need a join, told from those that can't by a table of bits that every task holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


def bit(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BITS)).alias("bit")


def words(marked: DataFrame) -> DataFrame:
    """word_, set_: the bits that occur among `marked` (bit), 64 in a word; BITS / 64 rows at most."""
    return marked.groupBy(F.expr("bit div 64").alias("word_")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("set_"))


def parted(rows: DataFrame, marked: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key's bit isn't among `marked` (bit, or `words` of such), and the others; no row is shuffled for it."""
    table = marked if "set_" in marked.columns else words(marked)
    d = rows.withColumn("bit_", bit(*key)).withColumn("word_", F.expr("bit_ div 64")).join(F.broadcast(table), "word_", "left")
    hit = F.expr("coalesce(set_ & shiftleft(1L, CAST(bit_ % 64 AS INT)), 0L) <> 0")
    return d.filter(~hit).select(*rows.columns), d.filter(hit).select(*rows.columns)
