"""From raw documents to packed training sequences: reject toxic texts, drop near-duplicates, mask personal data,
mix the sources to their target weights, pack by powers of two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import minhash, mixing, packing, pii, toxicity
from chronolith.llm.common import materialize

SLOTS = 8  # of a stretch that stays together in the order of the schedule


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the last category of the chain doesn't reject; trained on the labelled ones among `docs`.

    Null and empty texts and rows without doc_id stay; without labels all rows stay.
    """
    return toxicity.drop_rejected(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id; rows in no group, and without doc_id, stay."""
    return minhash.drop_near_duplicates(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with identifiers replaced by their kind; all other columns, and null and empty texts, as they are."""
    return pii.mask_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each part of a document in each slot of the schedule, so sources weigh what their targets say.

    Every token appears at least once.  Only documents across a block's edge are cut.  The columns are those of the
    documents; the slot is in the order of the rows: each file holds stretches of SLOTS slots in the order of the
    schedule, and packing keeps that order.
    """
    keep = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    mixed = mixing.mix(docs, keep=keep, names=[f"kept_{i}" for i in range(len(keep))])
    columns = {"doc_id": F.col("doc_id"), "source": F.col("source"), "text": F.col("text")}
    for i, c in enumerate(keep):
        kept = F.col(f"kept_{i}")
        recount = F.length("text").cast(docs.schema[c].dataType)
        columns[c] = F.when(F.col("whole"), kept).otherwise(recount) if c == "n_chars" else kept
    ordered = mixed.repartition(F.expr(f"slot div {SLOTS}")).sortWithinPartitions("slot", "doc_id", "start")
    return ordered.select(*[columns[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2**k tokens, none across two documents; null, empty and blank texts give none."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", mask_pii),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: MinHash, the classifier chain and the detectors have no SQL; a test holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of `sf_dir`, each written and read again: doc_id, bucket, start, n_tokens, text.

    `start` counts within the part that mixing cut, which may appear several times.  Null, empty and blank texts give
    no row; a null doc_id and a null source are values like others; repeated rows with a doc_id count once, those
    without are each kept; texts of any length are used whole; an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
