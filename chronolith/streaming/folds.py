"""Running folds over streams, equal to the batch operators over all rows so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract, facts
from ..operators.facts import Facts

CONFLICT = "code string, entity_id string, details string"
SUMMARY = "kind string, code string, entity_id string, details string, count long"


def conflicts(spark: SparkSession, folder: str, schema: str = CONFLICT) -> DataFrame:
    """A stream of conflict rows, or with SUMMARY of counts, from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def signature_counts(stream: DataFrame) -> DataFrame:
    return stream.filter("code IS NOT NULL").groupBy("code", "entity_id", "details").agg(F.count("*").alias("count"))


def code_counts(stream: DataFrame) -> DataFrame:
    return stream.filter("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("count"))


def summary(stream: DataFrame) -> DataFrame:
    """Both counts in one aggregation: each conflict counts for its signature and for its code."""
    none = F.lit(None).cast("string")
    both = F.array(F.struct(F.lit("signature").alias("kind"), "code", "entity_id", "details"), F.struct(F.lit("code").alias("kind"), "code", none.alias("entity_id"), none.alias("details")))
    rows = stream.filter("code IS NOT NULL").select(F.explode(both).alias("x")).select("x.*")
    return rows.groupBy("kind", "code", "entity_id", "details").agg(F.count("*").alias("count"))


def add_counts(stream: DataFrame) -> DataFrame:
    """The running sum of counts that come as chunks of summaries, of signatures or of codes."""
    return stream.groupBy(*[c for c in stream.columns if c != "count"]).agg(F.sum("count").alias("count"))


def events_by_window(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts a window of event time, with a watermark: windows are final, and their state goes, once they are `late` behind."""
    return stream.withWatermark("recorded_at", late).groupBy(F.window("recorded_at", width).alias("w"), "status").agg(F.count("*").alias("n")).select("w.start", "w.end", "status", "n")


def ingest(texts: DataFrame, start: Facts, now: Column, keep: Callable[[Facts, int], None], checkpoint: str, first_tx: int = 1) -> StreamingQuery:
    """Chunks a stream of texts (source, text) into a store; a batch is a transaction, numbered by its batch id.

    `keep` stores what each batch gave; the same batch seen again, after a failure, gives the same rows.
    """
    state = {"facts": start}

    def batch(rows: DataFrame, batch_id: int) -> None:
        tx = first_tx + batch_id
        state["facts"] = facts.assert_revisions(state["facts"], extract.chunk_claims(rows, tx, now))
        keep(state["facts"], tx)

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
