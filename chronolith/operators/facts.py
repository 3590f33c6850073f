"""Row constructors of the fact tables, and appending to them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as ident
from ..schema import CORES, JOURNAL, RELATION_TYPES, RELATIONS, REVISIONS, STATUSES


@dataclass(frozen=True)
class Facts:
    """The four tables of a store.  DataFrames don't change, so a copy or a checkpoint is the object itself."""

    cores: DataFrame
    revisions: DataFrame
    relations: DataFrame
    journal: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Facts:
        return cls(*(spark.createDataFrame([], s) for s in (CORES, REVISIONS, RELATIONS, JOURNAL)))


def _check(ok: Column, message: str, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def cores(rows: DataFrame) -> DataFrame:
    """Cores with identities from rows (claim_type, slots)."""
    d = rows.select(ident.canonical("claim_type").alias("claim_type"), ident.canonical_slots(F.col("slots")).alias("slots"))
    return d.select(ident.core_id(F.col("claim_type"), F.col("slots")).alias("core_id"), "claim_type", "slots")


def revisions(rows: DataFrame) -> DataFrame:
    """Revisions with identities; rejects bad status, confidence, transaction and valid time."""
    d = rows.select(
        "core_id",
        ident.canonical("assertion").alias("assertion"),
        F.col("vt_start").cast("timestamp").alias("vt_start"),
        _check(F.col("vt_end").isNull() | (F.col("vt_end") > F.col("vt_start")), "valid time must end after it starts", F.col("vt_end")).cast("timestamp").alias("vt_end"),
        _check(F.col("tx_id") >= 0, "tx_id must not be negative", F.col("tx_id")).cast("long").alias("tx_id"),
        F.col("recorded_at").cast("timestamp").alias("recorded_at"),
        ident.canonical("source").alias("source"),
        ident.canonical(F.col("evidence_ref").cast("string")).alias("evidence_ref"),
        _check(F.col("confidence_bp").between(0, 10000), "confidence_bp must be 0 to 10000", F.col("confidence_bp")).cast("int").alias("confidence_bp"),
        _check(ident.canonical("status").isin(*STATUSES), "status must be asserted or retracted", ident.canonical("status")).alias("status"),
    )
    return d.select(ident.revision_id().alias("revision_id"), *d.columns)


def relations(rows: DataFrame) -> DataFrame:
    """Relations with identities; endpoints of `contradicts` are put in order."""
    kind = ident.canonical("relation_type")
    a, b = F.col("from_revision_id"), F.col("to_revision_id")
    swap = (kind == "contradicts") & (a > b)
    d = rows.select(
        _check(kind.isin(*RELATION_TYPES), "unsupported relation_type", kind).alias("relation_type"),
        F.when(swap, b).otherwise(a).alias("from_revision_id"),
        F.when(swap, a).otherwise(b).alias("to_revision_id"),
        F.col("tx_id").cast("long").alias("tx_id"),
        F.col("recorded_at").cast("timestamp").alias("recorded_at"),
    )
    return d.select(ident.relation_id().alias("relation_id"), *d.columns)


def append(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Idempotent insert by identity: rows whose id is there already are left out."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def assert_revisions(facts: Facts, rows: DataFrame) -> Facts:
    """Add claims (claim_type, slots and the columns of a revision) to a store."""
    d = rows.select("*", ident.canonical("claim_type").alias("ct_"), ident.canonical_slots(F.col("slots")).alias("sl_"))
    d = d.drop("claim_type", "slots", "core_id").withColumnsRenamed({"ct_": "claim_type", "sl_": "slots"})
    d = d.withColumn("core_id", ident.core_id(F.col("claim_type"), F.col("slots")))
    return replace(facts, cores=append(facts.cores, d.select("core_id", "claim_type", "slots"), "core_id"), revisions=append(facts.revisions, revisions(d), "revision_id"))


def attach_relations(facts: Facts, rows: DataFrame) -> tuple[Facts, DataFrame]:
    """Add edges whose endpoints exist; the second value holds the rejected ones."""
    new, known = relations(rows), facts.revisions.select("revision_id")
    good = new
    for side in ("from_revision_id", "to_revision_id"):
        good = good.join(known.withColumnRenamed("revision_id", side), side, "left_semi")
    good = good.select(*new.columns)
    return replace(facts, relations=append(facts.relations, good, "relation_id")), new.join(good.select("relation_id"), "relation_id", "left_anti")


def retract(targets: DataFrame, tx_id: int, recorded_at: Column, source: str, evidence: str | None = None) -> DataFrame:
    """Retraction rows for asserted revisions: same claim and interval, new transaction and provenance."""
    d = targets.filter("status = 'asserted'").withColumns({
        "status": F.lit("retracted"), "tx_id": F.lit(tx_id).cast("long"), "recorded_at": recorded_at,
        "source": F.lit(source), "evidence_ref": F.lit(evidence).cast("string"),
    })
    return revisions(d)


def core_revisions(revs: DataFrame, core: str) -> DataFrame:
    return revs.filter(F.col("core_id") == core).orderBy("revision_id")


def tainted(revs: DataFrame) -> DataFrame:
    """Cores with any retraction, at whatever time."""
    return revs.filter("status = 'retracted'").select("core_id").distinct()


def active(revs: DataFrame) -> DataFrame:
    """Asserted revisions of cores that were never retracted."""
    return revs.filter("status = 'asserted'").join(tainted(revs), "core_id", "left_anti")
