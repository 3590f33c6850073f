"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of those before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import batches_of, column_bytes, mix64, words
from .common import in_arrow, with_id

CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
MAX_TRAIN = 6000  # labelled rows that training may gather, whatever the size of the tables
BITS = 18
FOLDS = 3
REJECT = 0.4
MARKED = 5.0  # standard errors by which a word must depart from independence to enter a model


def _features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, and the words of each text."""
    h, doc, _ = words(raw, off)
    n = np.bincount(doc, minlength=len(off) - 1)
    key = np.unique((doc.astype(np.uint64) << np.uint64(BITS)) | (mix64(h) & np.uint64((1 << BITS) - 1)))
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64), n


def _collect_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = column_bytes(batch.column("text"))
        doc, feature, n = _features(raw, off)
        cut = np.searchsorted(doc, np.arange(len(off)))
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feature, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("labels"), lists, pa.array(n, pa.int64())], names=["labels", "features", "n"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(row: np.ndarray, col: np.ndarray, dense: np.ndarray, y: np.ndarray, dims: int, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression with a ridge, by Adam on all rows; deterministic."""
    w, b = np.zeros(dims), np.zeros(dense.shape[1])
    m, v, mb, vb = np.zeros(dims), np.zeros(dims), np.zeros_like(b), np.zeros_like(b)
    n, ridge = max(1, len(y)), 1e-5
    for t in range(1, steps + 1):
        e = (_sigmoid(np.bincount(row, w[col], len(y)) + dense @ b) - y) / n
        g, gb = np.bincount(col, e[row], dims) + ridge * w, dense.T @ e + ridge * b
        for x, gx, mx, vx in ((w, g, m, v), (b, gb, mb, vb)):
            mx += 0.1 * (gx - mx)
            vx += 0.01 * (gx * gx - vx)
            x -= 0.1 * (mx / (1 - 0.9**t)) / (np.sqrt(vx / (1 - 0.99**t)) + 1e-8)
    return w, b


def folds_of(row: np.ndarray, col: np.ndarray, rows: int) -> np.ndarray:
    """Fold of each row by a hash of its features, so copies of a text stand in one fold."""
    h = np.zeros(rows, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(h, row, mix64(col.astype(np.uint64) + np.uint64(1)))
    return (mix64(h) % np.uint64(FOLDS)).astype(np.int64)


def fit_chain(row: np.ndarray, col: np.ndarray, n_words: np.ndarray, y: np.ndarray) -> dict:
    """The models of a chain from sparse presence features; y has a column a category, NaN where a label is missing.

    Category k is fitted on the words and the probabilities of categories before it.  For training those
    probabilities are out of fold: each row's come from models that were fitted without the row's fold, and copies of a
    text share a fold.
    """
    rows, cats = y.shape
    base = np.column_stack([np.ones(rows), np.log1p(n_words)])
    fold, earlier, models = folds_of(row, col, rows), np.zeros((rows, 0)), []

    def fit(at: np.ndarray, dense: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        number = np.full(rows, -1, np.int64)
        number[at] = np.arange(len(at))
        inside = number[row] >= 0
        r, c, told = number[row[inside]], col[inside], y[at, k]
        # words that go with the category more, or less, than chance explains
        seen, share = np.bincount(c, minlength=1 << BITS), told.mean() if len(told) else 0.0
        z = (np.bincount(c, told[r], 1 << BITS) - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
        used = np.flatnonzero((np.abs(z) >= MARKED) & (seen >= 3) & (0 < share < 1))
        back = np.full(1 << BITS, -1, np.int64)
        back[used] = np.arange(len(used))
        ok = back[c] >= 0
        w, b = _fit(r[ok], back[c[ok]], dense[at], told, len(used))
        full = np.zeros(1 << BITS)
        full[used] = w
        return full, b

    for k in range(cats):
        dense, told = np.column_stack([base, earlier]), ~np.isnan(y[:, k])
        out = np.zeros(rows)
        for f in range(FOLDS):
            w, b = fit(np.flatnonzero(told & (fold != f)), dense, k)
            p = _sigmoid(np.bincount(row, w[col], rows) + dense @ b)
            out[fold == f] = p[fold == f]
        w, b = fit(np.flatnonzero(told), dense, k)
        models.append((w.astype(np.float32), b))
        earlier = np.column_stack([earlier, out])
    return {"models": models, "out_of_fold": earlier}


def train(docs: DataFrame, labels: DataFrame, chain: tuple = CHAIN, max_train: int = MAX_TRAIN) -> list:
    """Fit the chain on the `max_train` labelled documents that come first by a hash of doc_id.

    Only hashed features of these rows reach the driver.  Their ids are broadcast: at most `max_train`.
    Labels of one doc_id that repeat count once: it is in a category if one of them says so.  A null label is left out
    of its category.  Rows without doc_id, and columns that no rule of the chain names, are ignored.
    """
    told = labels.filter("doc_id IS NOT NULL").select("doc_id", *[F.expr(f"CAST({rule} AS DOUBLE)").alias(f"y{k}") for k, (_, rule) in enumerate(chain)])
    flat = told.groupBy("doc_id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(chain))])
    picked = flat.select("doc_id", F.array(*[f"y{k}" for k in range(len(chain))]).alias("labels")).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(max_train)
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    got = in_arrow(texts.select("text", "labels"), _collect_features, "labels array<double>, features array<int>, n bigint").toArrow()
    # the order in which rows arrive must not matter
    rows = sorted(zip(got["features"].to_pylist(), got["labels"].to_pylist(), got["n"].to_pylist(), strict=True), key=lambda x: (x[2], x[0], str(x[1])))
    if not rows:
        return []
    y = np.array([[np.nan if v is None else v for v in x[1]] for x in rows], dtype=float)
    row = np.repeat(np.arange(len(rows)), [len(x[0]) for x in rows])
    col = np.concatenate([np.array(x[0], np.int64) for x in rows]) if len(row) else np.zeros(0, np.int64)
    return fit_chain(row, col, np.array([x[2] for x in rows]), y)["models"]


def _probabilities(raw: np.ndarray, off: np.ndarray, models: list) -> np.ndarray:
    out = np.zeros((len(off) - 1, len(models)))
    for i, j in batches_of(raw, off):
        doc, feature, n = _features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        dense = np.column_stack([np.ones(j - i), np.log1p(n)])
        for k, (w, b) in enumerate(models):
            p = _sigmoid(np.bincount(doc, w[feature], j - i) + dense @ b)
            out[i:j, k] = p
            dense = np.column_stack([dense, p])
    return out


def toxicity(docs: DataFrame, labels: DataFrame, chain: tuple = CHAIN, max_train: int = MAX_TRAIN, reject: float = REJECT) -> DataFrame:
    """Probabilities of every category for every document, and whether it is rejected by the last one.

    Categories are predicted in the order of `chain` (name, rule over the columns of `labels`): a model is linear in
    the presence of hashed words, the log length, and the probabilities of the categories before it.  The last
    category is the one that rejects.  Training is bounded by `max_train` labelled rows; scoring is one pass over all
    whole texts, without a shuffle (weights: 1 MB a category).

    Result: doc_id, p_<category>..., rejected.
    Null and empty texts have no word; they get the probability of an empty text and are never rejected.  A null
    doc_id is kept.  Repeated rows are scored each for itself, texts of any length whole.  Without any labelled text all probabilities are null
    and nothing is rejected.  Other columns are ignored, whatever their names.
    """
    return score(docs, train(docs, labels, chain, max_train), chain, reject)


def _judged(raw: np.ndarray, off: np.ndarray, models: list, reject: float) -> tuple[np.ndarray, np.ndarray]:
    p = _probabilities(raw, off, models)
    return p, (p[:, -1] >= reject) & (np.diff(off) > 0)


def score(docs: DataFrame, models: list, chain: tuple = CHAIN, reject: float = REJECT) -> DataFrame:
    """doc_id (of any type), p_<category>..., rejected, by models from `train`; odd rows as in `toxicity`."""
    names = [f"p_{name}" for name, _ in chain]
    if not models:
        return docs.select("doc_id", *[F.lit(None).cast("double").alias(c) for c in names], F.lit(False).alias("rejected"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, bad = _judged(*column_bytes(batch.column("text")), models, reject)
            cols = [batch.column("doc_id"), *[pa.array(p[:, k]) for k in range(len(names))], pa.array(bad)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *names, "rejected"])

    d = docs.select("doc_id", "text")
    return in_arrow(d, run, with_id(d, f"{', '.join(f'{c} double' for c in names)}, rejected boolean"))


def drop_rejected(docs: DataFrame, models: list, reject: float = REJECT) -> DataFrame:
    """The rows of `docs`, all columns, that the last category doesn't reject; one pass, no shuffle, no join.

    Null and empty texts stay; repeated rows are judged each for itself, whole texts whatever their length; without
    models all rows stay; an empty table gives an empty result.
    """
    if not models:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, bad = _judged(*column_bytes(batch.column(at)), models, reject)
            yield batch.filter(pa.array(~bad))

    at = docs.columns.index("text")
    return in_arrow(docs, run, docs.schema)
