"""Chunks of text as facts: the view that search and reports read, and positions within a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from . import asof
from .facts import Facts, tainted
from .parted import bit, parted, words

CHUNK = "document.chunk@v1"
INTERNAL = "internal."  # claim types of the library's own bookkeeping
BUCKET = 4096  # chunk numbers that are put in order together


def view(facts: Facts) -> DataFrame:
    """revisions joined with their cores: one row a revision, with source, chunk_idx, page_start and text."""
    slot = F.col("slots")
    r = facts.revisions.withColumnRenamed("source", "provenance").join(facts.cores, "core_id")
    return r.select(
        "revision_id", "core_id", "claim_type", "slots", F.coalesce(slot["source"], F.lit("unknown")).alias("source"),
        F.coalesce(F.try_to_number(slot["chunk_idx"], F.lit("999999999")).cast("long"), F.lit(0).cast("long")).alias("chunk_idx"),
        F.try_to_number(slot["page_start"], F.lit("999999999")).cast("int").alias("page_start"), F.col("assertion").alias("text"),
        "vt_start", "vt_end", "tx_id", "recorded_at", "provenance", "evidence_ref", "confidence_bp", "status",
    )


def active(chunks: DataFrame) -> DataFrame:
    """Asserted rows of cores that were never retracted."""
    return chunks.filter("status = 'asserted'").join(tainted(chunks), "core_id", "left_anti")


def known_at(chunks: DataFrame, tx_id: int | None, valid_at: str | Column | None) -> DataFrame:
    """Rows that win their core at the coordinates; the active rows unless both are given."""
    if tx_id is None or valid_at is None:
        return active(chunks)
    won = asof.query_as_of(chunks, tx_id, valid_at).select("revision_id")
    return chunks.join(won, "revision_id", "left_semi")


def active_in_place(chunks: DataFrame) -> DataFrame:
    """`active`, where only rows are shuffled that share a bit with a retracted core without being of one.

    The bits, and which rows these are, are found once, by keys without texts, and written; each use reads chunks twice.
    """
    asserted, key = chunks.filter("status = 'asserted'"), ("revision_id", "core_id")
    bits = written(words(chunks.filter("status = 'retracted'").select(bit("core_id"))), "bits")
    clear, rest = parted(asserted, bits, "core_id")
    kept = written(rest.select(*key).join(tainted(chunks), "core_id", "left_anti").select(*[F.col(k).alias(f"{k}_") for k in key]).distinct(), "kept")
    some = parted(rest, kept.select(bit(*[f"{k}_" for k in key])), *key)[1]
    same = F.col("revision_id").eqNullSafe(F.col("revision_id_")) & F.col("core_id").eqNullSafe(F.col("core_id_"))
    return clear.unionByName(some.join(kept, same, "left_semi").select(*rest.columns))


def known_in_place(rows: DataFrame, tx_id: int | None, valid_at: str | Column | None) -> DataFrame:
    """`known_at` of active rows, where only rows are shuffled whose core has another candidate, or shares a bit with one
    that has; these cores are found once, by keys without texts, and written."""
    if tx_id is None or valid_at is None:
        return rows
    c = asof.candidates(rows, tx_id, valid_at)
    ids = parted(c, c.groupBy(bit("core_id")).count().filter("count > 1"), "core_id")[1].select("core_id")
    several = written(words(ids.groupBy("core_id").count().filter("count > 1").select(bit("core_id"))), "several")
    clear, rest = parted(c, several, "core_id")
    won = asof.query_as_of(rest, tx_id, valid_at).select("revision_id")
    return clear.unionByName(rest.join(won, "revision_id", "left_semi").select(*rest.columns))


def documents(chunks: DataFrame) -> DataFrame:
    """The active chunks of documents; bookkeeping claims aren't among them."""
    return active(chunks).filter(F.col("claim_type") == CHUNK)


def positions(chunks: DataFrame) -> DataFrame:
    """`pos`: the place of each row in its source, by (chunk_idx, revision_id).

    Rows are numbered inside stretches of chunk numbers, behind the counts of the stretches before, so a source with
    a third of all rows is many tasks.
    """
    d = chunks.withColumn("stretch", F.expr(f"chunk_idx div {BUCKET}"))
    counts = d.groupBy("source", "stretch").agg(F.count("*").alias("c"))
    before = counts.select("source", "stretch", (F.sum("c").over(Window.partitionBy("source").orderBy("stretch")) - F.col("c")).alias("before"))
    inner = Window.partitionBy("source", "stretch").orderBy("chunk_idx", "revision_id")
    return d.withColumn("n", F.row_number().over(inner)).join(before, ["source", "stretch"]).withColumn("pos", F.col("before") + F.col("n")).drop("n", "before", "stretch")
