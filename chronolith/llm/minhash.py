"""Near-duplicates by one-permutation MinHash with optimal densification, bands and star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .bytesops import batches_of, column_bytes, mix64, words
from .common import fresh, in_arrow, materialize, with_id

BINS = 128
ROWS = 4  # bins of a band; their 4 x 16 bits are the band's bucket
SHINGLE = 3  # words
THRESHOLD = 0.6
BLOCK = 1024  # members of a bucket that are compared with as many others at once


def signatures(raw: np.ndarray, off: np.ndarray, bins: int = BINS, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts x bins, 16 bits each) and which texts have a word at all.

    Every shingle falls in one bin by its hash and the smallest hash of a bin is its value: one permutation gives all
    bins.  An empty bin j copies the bin that a hash of (j, attempt) points to, trying until it meets a bin that was
    filled by a shingle (optimal densification).  A text shorter than a shingle counts as one shingle.
    """
    n = len(off) - 1
    h, doc, _ = words(raw, off)
    have = np.bincount(doc, minlength=n)
    s = h.copy()
    with np.errstate(over="ignore"):
        for k in range(1, shingle):
            s *= np.uint64(0x9E3779B97F4A7C15)
            same = np.zeros(len(h), bool)
            same[: len(h) - k] = doc[k:] == doc[: len(h) - k]
            s[: len(h) - k] += np.where(same[: len(h) - k], h[k:], np.uint64(0))
    place = np.arange(len(h)) - np.repeat(np.cumsum(have) - have, have)
    full = place + shingle <= np.maximum(have[doc], shingle)
    s, d = mix64(s[full]), doc[full]
    empty = np.uint64((1 << 64) - 1)
    sig = np.full(n * bins, empty)
    np.minimum.at(sig, d * bins + (s % np.uint64(bins)).astype(np.int64), s)
    sig = sig.reshape(n, bins)
    hole = sig == empty
    some = have > 0
    todo = hole & some[:, None]
    out, attempt = sig.copy(), 0
    while todo.any():
        attempt += 1
        to = (mix64(np.arange(bins, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        r, c = np.nonzero(todo)
        hit = ~hole[r, to[c]]
        out[r[hit], c[hit]] = sig[r[hit], to[c[hit]]]
        todo[r[hit], c[hit]] = False
    return (mix64(out) & np.uint64(0xFFFF)).astype(np.uint16), some


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = column_bytes(batch.column("text"))
        for i, j in batches_of(raw, off):
            sig, some = signatures(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            ids = batch.column("doc_id").slice(i, j - i).filter(pa.array(some))
            blobs = pa.array([x.tobytes() for x in sig[some]], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, blobs], names=["doc_id", "sig"])


def _forest(threshold: float) -> Callable:
    """Of the pairs between (i < j) or within (i = j) two blocks that agree in `threshold`: edges that connect the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                m = batch.column("m")[row].values
                sig = np.frombuffer(b"".join(m.field("sig").to_pylist()), np.uint16).reshape(len(m), -1)
                block, i, j = m.field("block").to_numpy(), batch.column("i")[row].as_py(), batch.column("j")[row].as_py()
                x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
                need, root, edges = int(np.ceil(threshold * sig.shape[1] - 1e-9)), np.arange(len(m)), []
                for p in x.tolist():
                    for q in y[(sig[y] == sig[p]).sum(axis=1) >= need].tolist():
                        a, b = root[p], root[q]
                        if a != b:
                            root[root == max(a, b)] = min(a, b)
                            edges.append((min(p, q), max(p, q)))
                ids = m.field("id")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([e[k] for e in edges], pa.int64())) for k in (0, 1)], names=["a", "b"])

    return run


@F.pandas_udf(DoubleType())
def resemblance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal bins of two signatures."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint16).reshape(len(b), -1)
    return pd.Series((x == y).mean(axis=1))


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest id of the component) of every node of the edges (a, b), a < b.

    Rounds of large-star and small-star: each node's larger, then smaller neighbours are linked to its smallest one,
    until nothing changes; the rounds grow with the logarithm of the longest path.  Every round is written out.
    """
    edges, was = materialize(edges.select("a", "b").distinct(), "edges"), None
    while (now := edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()) != was:  # one row
        was = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        new = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b")
        edges = materialize(new.distinct(), "edges")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, kept_id) of each document that repeats another, and the document of its group that stays.

    Texts are read once, into 256-byte signatures that are written to the shared folder.  Equal signatures are one
    class.  Classes meet in band buckets; a bucket of m classes gives m - 1 edges from its smallest id, so pairs grow
    with the documents, never with the square of a group.  Edges whose signatures agree in `threshold` of the bins
    hold; members whose star edge failed in a bucket form a second star there, and those that fail in this one too are
    compared with each other in blocks, which put out no more edges than members.  So classes that meet in a bucket
    are joined exactly as if all pairs of it were compared.  Connected classes are a group, and its smallest doc_id stays.

    Result: doc_id (of any type that sorts), kept_id, a row for each document that goes.
    Words are compared without ASCII case and punctuation.  Null and empty texts, and texts without a word, are in no
    group; so are rows without doc_id.  Of ties the smallest doc_id stays.  Rows that repeat a doc_id count as one
    document, which is compared with itself by nothing; its texts may join several groups.  An empty table gives an
    empty result.  Texts of any length count whole.  Other columns are ignored, whatever their names.
    """
    d = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    id_type = d.schema["doc_id"].dataType
    sigs = materialize(in_arrow(d, _scan, with_id(d, "sig binary")), "signatures")
    classes = materialize(sigs.groupBy("sig").agg(F.min("doc_id").alias("id")), "classes")
    equal = sigs.join(classes, "sig").filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    width = 2 * ROWS
    bands = F.expr(f"transform(sequence(0, {BINS // ROWS - 1}), b -> struct(b AS band, substring(sig, b * {width} + 1, {width}) AS h))")
    members = classes.select("id", F.explode(bands).alias("k")).select("id", "k.band", "k.h")

    def stars(m: DataFrame) -> DataFrame:
        center = m.groupBy("band", "h").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
        return m.join(center, ["band", "h"]).filter("id <> a").select("band", "h", "a", F.col("id").alias("b"))

    def rest(failed: DataFrame) -> DataFrame:
        """Edges among the members that two stars left in a bucket: pairs of blocks of it, each in one task."""
        m = failed.groupBy("band", "h").agg(F.count("*").alias("m")).filter("m > 1")
        m = failed.join(m, ["band", "h"]).withColumn("n", F.ceil(F.col("m") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("id"), "n"))
        meet = m.withColumn("other", F.explode(F.expr("sequence(0L, n - 1)")))
        meet = meet.select("band", "h", "id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        member = F.struct("id", "block", "sig").alias("x")
        groups = meet.join(classes, "id").groupBy("band", "h", "i", "j").agg(F.array_sort(F.collect_list(member)).alias("m"))
        return in_arrow(groups.select("i", "j", "m"), _forest(threshold), StructType([StructField(x, id_type) for x in "ab"]))

    def verified(e: DataFrame) -> DataFrame:
        a, b = classes.select(F.col("id").alias("a"), F.col("sig").alias("sa")), classes.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
        pairs = e.select("a", "b").distinct().join(a, "a").join(b, "b")
        return pairs.select("a", "b", (resemblance("sa", "sb") >= threshold).alias("ok"))

    first = materialize(stars(members), "stars")
    judged = materialize(verified(first), "judged")
    failed = first.join(judged.filter("NOT ok"), ["a", "b"]).select("band", "h", F.col("b").alias("id"))
    again = materialize(stars(failed), "stars")
    second = materialize(verified(again), "judged")
    left = again.join(second.filter("NOT ok"), ["a", "b"]).select("band", "h", F.col("b").alias("id"))
    edges = equal.unionByName(judged.filter("ok").select("a", "b")).unionByName(second.filter("ok").select("a", "b")).unionByName(rest(left).distinct())
    return components(edges.filter("a < b")).filter("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("kept_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, without the documents that `near_duplicates` lets go.

    Rows without doc_id, and rows in no group, stay as they are.  Of rows that agree in doc_id and text one stays.
    """
    gone = near_duplicates(docs, threshold).select(F.col("doc_id").alias(fresh(docs, "gone")))
    left = docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")
    twice = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(fresh(docs, "twice")))
    if twice.isEmpty():
        return left
    t = F.col(twice.columns[0])
    return left.join(twice, left["doc_id"] == t, "left_anti").unionByName(left.join(twice, left["doc_id"] == t, "left_semi").dropDuplicates(["doc_id", "text"]))
