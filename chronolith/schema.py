"""Schemas of the fact tables."""

from pyspark.sql import types as T

CORES = T.StructType([
    T.StructField("core_id", T.StringType(), False),
    T.StructField("claim_type", T.StringType(), False),
    T.StructField("slots", T.MapType(T.StringType(), T.StringType()), False),
])
REVISIONS = T.StructType([
    T.StructField("revision_id", T.StringType(), False),
    T.StructField("core_id", T.StringType(), False),
    T.StructField("assertion", T.StringType(), False),
    T.StructField("vt_start", T.TimestampType(), False),
    T.StructField("vt_end", T.TimestampType(), True),
    T.StructField("tx_id", T.LongType(), False),
    T.StructField("recorded_at", T.TimestampType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("evidence_ref", T.StringType(), True),
    T.StructField("confidence_bp", T.IntegerType(), False),
    T.StructField("status", T.StringType(), False),
])
RELATIONS = T.StructType([
    T.StructField("relation_id", T.StringType(), False),
    T.StructField("relation_type", T.StringType(), False),
    T.StructField("from_revision_id", T.StringType(), False),
    T.StructField("to_revision_id", T.StringType(), False),
    T.StructField("tx_id", T.LongType(), False),
    T.StructField("recorded_at", T.TimestampType(), False),
])
JOURNAL = T.StructType([
    T.StructField("tx_id", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("code", T.StringType(), True),
    T.StructField("entity_id", T.StringType(), True),
    T.StructField("details", T.StringType(), True),
])
RELATION_TYPES = ("contradicts", "depends_on", "derived_from", "supports")
STATUSES = ("asserted", "retracted")
