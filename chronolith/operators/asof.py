"""As-of winners, projections over them, and their window and transition forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import iso
from .parted import bit, parted


def at(v: str | Column) -> Column:
    return F.lit(v).cast("timestamp") if isinstance(v, str) else v


def candidates(revs: DataFrame, tx_id: int, valid_at: str | Column) -> DataFrame:
    """Revisions known at tx_id whose interval holds valid_at; this filter must stand below any grouping."""
    v = at(valid_at)
    return revs.filter((F.col("tx_id") <= tx_id) & (F.col("vt_start") <= v) & (F.col("vt_end").isNull() | (v < F.col("vt_end"))))


def winners(revs: DataFrame, tx_id: int, valid_at: str | Column) -> DataFrame:
    """core_id, revision_id, status, tx_id of each core's winner.

    In an interval the latest transaction wins, then a retraction, then the smaller id; across intervals any
    assertion beats all retractions.  Both steps are minima of structs, so they combine before the shuffle, and a
    hot core is spread by its intervals first.
    """
    c = candidates(revs, tx_id, valid_at)
    rank = F.struct((-F.col("tx_id")).alias("t"), F.when(F.col("status") == "retracted", 0).otherwise(1).alias("s"), "revision_id")
    slots = c.groupBy("core_id", "vt_start", "vt_end").agg(F.min(rank).alias("w"))
    best = slots.groupBy("core_id").agg(F.min(F.struct((1 - F.col("w.s")).alias("r"), "w.t", "w.revision_id")).alias("w"))
    return best.select(
        "core_id", "w.revision_id", F.when(F.col("w.r") == 1, "retracted").otherwise("asserted").alias("status"), (-F.col("w.t")).alias("tx_id")
    )


def query_as_of(revs: DataFrame, tx_id: int, valid_at: str | Column, core_id: str | None = None) -> DataFrame:
    """Winners that are assertions; with core_id, of that core alone (the filter reaches the scan)."""
    r = revs if core_id is None else revs.filter(F.col("core_id") == core_id)
    return winners(r, tx_id, valid_at).filter("status = 'asserted'")


def revision_lifecycle(revs: DataFrame, tx_id: int, valid_at: str | Column, core_id: str | None = None) -> DataFrame:
    """bucket (active, retracted), id, tx_id of every winner."""
    r = revs if core_id is None else revs.filter(F.col("core_id") == core_id)
    bucket = F.when(F.col("status") == "retracted", "retracted").otherwise("active")
    return winners(r, tx_id, valid_at).select(bucket.alias("bucket"), F.col("revision_id").alias("id"), "tx_id")


def with_bucket(relations: DataFrame, revs: DataFrame) -> DataFrame:
    """Relations with `bucket`: pending while an endpoint is unknown.  Nothing is promoted; the bucket is computed."""
    ids = revs.select("revision_id")
    ends = relations.select(bit("from_revision_id", "to_revision_id"), F.explode(F.array("from_revision_id", "to_revision_id")).alias("revision_id"))
    # edges stay where they are unless an endpoint of theirs, or of others with the same bit, is missing
    clear, d = parted(relations, ends.join(ids, "revision_id", "left_anti"), "from_revision_id", "to_revision_id")
    ids = ids.distinct()
    for side, flag in (("from_revision_id", "f_"), ("to_revision_id", "t_")):
        d = d.join(ids.select(F.col("revision_id").alias(side), F.lit(True).alias(flag)), side, "left")
    d = d.withColumn("bucket", F.when(F.col("f_") & F.col("t_"), "active").otherwise("pending")).select(*relations.columns, "bucket")
    return clear.withColumn("bucket", F.lit("active")).unionByName(d)


def _touches(d: DataFrame, revision_id: str | None) -> DataFrame:
    return d if revision_id is None else d.filter((F.col("from_revision_id") == revision_id) | (F.col("to_revision_id") == revision_id))


def relations_as_of(bucketed: DataFrame, revs: DataFrame, tx_id: int, valid_at: str | Column | None = None, revision_id: str | None = None, active_only: bool = False) -> DataFrame:
    """Edges known at tx_id with both endpoints known; active_only keeps those whose endpoints both win their cores."""
    if active_only and valid_at is None:
        raise ValueError("active_only needs valid_at")
    d = _touches(bucketed.filter((F.col("tx_id") <= tx_id) & (F.col("bucket") == "active")), revision_id)
    if active_only:
        w = winners(revs, tx_id, valid_at).filter("status = 'asserted'").select("revision_id")
        for side in ("from_revision_id", "to_revision_id"):
            d = d.join(w.withColumnRenamed("revision_id", side), side, "left_semi")
    return d


def pending_relations_as_of(bucketed: DataFrame, tx_id: int, revision_id: str | None = None) -> DataFrame:
    return _touches(bucketed.filter((F.col("tx_id") <= tx_id) & (F.col("bucket") == "pending")), revision_id)


def relation_lifecycle(bucketed: DataFrame, revs: DataFrame, tx_id: int, valid_at: str | Column, revision_id: str | None = None) -> DataFrame:
    """bucket, id, tx_id and the payload of edges that are active (both endpoints win) or pending.

    Pending edges need no join, and only edges whose first endpoint wins reach the second.
    """
    d = _touches(bucketed.filter(F.col("tx_id") <= tx_id), revision_id)
    d = d.select("bucket", F.col("relation_id").alias("id"), "tx_id", "relation_type", "from_revision_id", "to_revision_id", "recorded_at")
    w = winners(revs, tx_id, valid_at).filter("status = 'asserted'").select("revision_id")
    live = d.filter("bucket = 'active'")
    for side in ("from_revision_id", "to_revision_id"):
        live = live.join(w.withColumnRenamed("revision_id", side), side, "left_semi")
    return live.select(*d.columns).unionByName(d.filter("bucket = 'pending'"))


def relation_resolution(bucketed: DataFrame, revs: DataFrame, tx_id: int, valid_at: str | Column, core_id: str | None = None) -> DataFrame:
    """Lifecycle of the edges of one core's winner (none without a winner), or of all edges."""
    all_edges = relation_lifecycle(bucketed, revs, tx_id, valid_at)
    if core_id is None:
        return all_edges
    w = query_as_of(revs, tx_id, valid_at, core_id).select(F.col("revision_id").alias("w_"))
    return all_edges.join(F.broadcast(w), (F.col("w_") == F.col("from_revision_id")) | (F.col("w_") == F.col("to_revision_id")), "left_semi")  # one row


def relation_signatures(lifecycle: DataFrame) -> DataFrame:
    """The lifecycle as flat tuples."""
    return lifecycle.select("bucket", F.col("id").alias("relation_id"), "relation_type", "from_revision_id", "to_revision_id", "tx_id", iso(F.col("recorded_at")).alias("recorded_at"))


def revision_signatures(revs: DataFrame) -> DataFrame:
    return revs.select(
        "revision_id", "core_id", "status", iso(F.col("vt_start")).alias("valid_start"), F.coalesce(iso(F.col("vt_end")), F.lit("")).alias("valid_end"), "tx_id", iso(F.col("recorded_at")).alias("recorded_at")
    )


def for_tx_window(project: Callable[[int], DataFrame], tx_start: int, tx_end: int) -> DataFrame:
    """The projection as of the window's end, of what was itself recorded inside the closed window."""
    if tx_end < tx_start:
        raise ValueError("tx_end must not be before tx_start")
    return project(tx_end).filter(F.col("tx_id").between(tx_start, tx_end))


def transition(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `after` that `before` lacks (entered) and the reverse (exited), by bucket and keys.

    Both sides are tagged and grouped once by what identifies a row, so each is computed once and combined before
    the shuffle.
    """
    on = ["bucket", *keys] if "bucket" in before.columns else keys
    rest = [c for c in before.columns if c not in on]
    both = before.withColumn("side", F.lit(0)).unionByName(after.withColumn("side", F.lit(1)))
    g = both.groupBy(*on).agg(F.min("side").alias("a"), F.max("side").alias("b"), *[F.min(c).alias(c) for c in rest]).filter("a = b")
    return g.withColumn("change", F.when(F.col("a") == 1, "entered").otherwise("exited")).select(*before.columns, "change")
