"""What the operators share: the folder for written intermediates, private column names, distributed prefix sums."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

WHITE = "[ \\t\\n\\r\\f]+"  # what separates tokens, spelled out so that every regex engine agrees
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from spark.checkpoint.dir; a temporary one only for a local master."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    return _own[app]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch, where the session doesn't say otherwise: Spark's 10,000 rows of long texts fill
#: buffers of tens of MB on both sides of every Python worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def _give_back() -> None:
    """Workers are reused: what a task no longer needs goes back to the system, not to the next task's peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def in_arrow(df: DataFrame, f: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """`mapInArrow` in small batches, by tasks that give their memory back."""
    conf = df.sparkSession.conf
    for name, small in BATCHES.items():
        if conf.get(name, None) is None:
            conf.set(name, small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def with_id(df: DataFrame, rest: str) -> StructType:
    """Schema of `doc_id`, typed as in `df`, and the fields of the DDL string `rest`."""
    return StructType([StructField("doc_id", df.schema["doc_id"].dataType), *StructType.fromDDL(rest).fields])


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have (names compare without case)."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name += "_"
    return name


def tokens(text: Column | str) -> Column:
    """The white-space separated tokens of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), WHITE), lambda x: x != "")


def running_sum(df: DataFrame, group: list[str], bucket: Column, order: list[Column], weight: Column, name: str) -> DataFrame:
    """Add `name`: the sum of `weight` over the rows of the same group before this one.

    No group passes through one task: rows are summed by (group, bucket), the sums of the buckets are run up (few
    rows a group), and inside a bucket a window adds the rest.  `bucket` must rise with `order`.
    """
    b, base = fresh(df, "bucket"), fresh(df, "base")
    df = df.withColumn(b, bucket)
    w = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, b).agg(F.sum(weight).alias(base)).withColumn(base, F.coalesce(F.sum(base).over(w), F.lit(0)))
    inner = Window.partitionBy(*group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sums, [*group, b]).withColumn(name, F.col(base) + F.coalesce(F.sum(weight).over(inner), F.lit(0))).drop(b, base)
