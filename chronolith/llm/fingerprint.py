"""Document fingerprints: digests of improbable byte windows in chained Bloom filters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import batches_of, column_bytes, mix64
from .common import in_arrow, materialize, with_id

WIDTH = 64  # bytes of a feature, and features of a popularity window
POPULAR = 16  # windows that must elect a feature
LEVELS = 1000
WEAK = 100  # entropy scores below this never make a feature
BITS = 2048  # of a filter
FULL = 160  # features of a filter
HASHES = 5
MATCH = 40.0
BLOCK = 1024  # digests, and filters, that are compared at once
SALTS = 16  # tasks at least among which the classes of one feature are spread
STRETCH = 1 << 19  # bytes of a long text that are looked at together
SHARED_BITS = 1 << 25  # of the table that tells features that may be shared: 4 MB, whatever the size of the corpus
_F = np.array([0] + [round(c * np.log2(c) * 65536) for c in range(1, WIDTH + 2)], np.int64)
_D = _F[:-1] - _F[1:]
_TOP = 6 * WIDTH * 65536
_NONE = np.int64(LEVELS + 1)


def entropy_scores(raw: np.ndarray) -> np.ndarray:
    """Entropy of the 64 bytes from each position, 0 to 1000, by exact integer updates from window to window."""
    n = len(raw) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    after, before = np.zeros(len(raw), np.uint8), np.zeros(len(raw), np.uint8)
    for a in range(0, len(raw), 1 << 16):  # stays in the cache
        b = min(len(raw), a + (1 << 16) + WIDTH - 1)
        part, x, y = raw[a:b], after[a:b], before[a:b]
        new = min(1 << 16, b - a)  # pairs that start in this part are counted here, once
        for j in range(1, WIDTH):
            m = min(new, len(part) - j)
            if m <= 0:
                break
            same = (part[:m] == part[j : j + m]).view(np.uint8)
            x[:m] += same
            y[j : j + m] += same
    t = np.empty(n, np.int64)
    t[0] = _F[np.bincount(raw[:WIDTH], minlength=256)].sum()
    t[1:] = _D[after[: n - 1]] - _D[before[WIDTH : WIDTH + n - 1]]
    return (_TOP - np.cumsum(t)) * LEVELS // _TOP


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LEVELS + 1, np.int64)
    for batch in batches:
        raw, off = column_bytes(batch.column("text"))
        for i, j in batches_of(raw, off, 1 << 18):
            if off[j] - off[i] > 2 * STRETCH:  # one long text
                for a in range(int(off[i]), int(off[j]), STRETCH):
                    total += np.bincount(entropy_scores(raw[a : min(a + STRETCH + WIDTH - 1, int(off[j]))]), minlength=LEVELS + 1)
                continue
            s = entropy_scores(raw[off[i] : off[j]])
            bad = np.zeros(len(s) + 1, np.int64)  # windows across two texts
            ends = off[i + 1 : j] - off[i]
            np.add.at(bad, np.clip(ends - WIDTH + 1, np.concatenate([[0], ends[:-1]]) if len(ends) else 0, len(s)), 1)
            np.add.at(bad, np.clip(ends, 0, len(s)), -1)
            total += np.bincount(s[np.cumsum(bad[:-1]) == 0], minlength=LEVELS + 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["score", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy score: the rarer over all windows of all documents, the lower; weak scores rank last."""
    counts = in_arrow(docs.select("text"), _counts, "score bigint, n bigint").groupBy("score").agg(F.sum("n").alias("n"))
    rows = sorted((r.n, r.score) for r in counts.collect())  # at most 1001
    rank = np.full(LEVELS + 1, _NONE, np.int64)
    for i, (_, score) in enumerate(rows):
        if score >= WEAK:
            rank[score] = i
    return rank


def select(raw: np.ndarray, off: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and start byte of the selected features.

    Each run of 64 neighbouring windows elects its first window of the lowest rank; a window with 16 votes is
    selected.  A text with fewer windows is one run, and its vote is enough.
    """
    s = entropy_scores(raw)
    n = len(s)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = np.maximum(np.diff(off) - WIDTH + 1, 0)
    key = (rank[s] << np.int64(40)) | np.arange(n)
    m, step = key.copy(), 1
    while step < WIDTH:
        m = np.minimum(m[: len(m) - step], m[step:]) if len(m) > step else m[:0]
        step *= 2
    runs = np.maximum(windows - WIDTH + 1, 0)
    begin = np.repeat(off[:-1], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    won = m[begin]
    won = won[won >> np.int64(40) < _NONE] & np.int64((1 << 40) - 1)
    chosen = np.flatnonzero(np.bincount(won, minlength=n) >= POPULAR)
    few = []
    for t in np.flatnonzero((windows > 0) & (runs == 0)):
        best = key[off[t] : off[t] + windows[t]].min()
        if best >> np.int64(40) < _NONE:
            few.append(best & np.int64((1 << 40) - 1))
    at = np.sort(np.concatenate([chosen, np.array(few, np.int64)]))
    return np.searchsorted(off, at, side="right") - 1, at


def selected(raw: np.ndarray, off: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`select`, a long text in stretches that overlap by all that a vote can depend on."""
    if len(raw) <= 2 * STRETCH:
        return select(raw, off, rank)
    doc, at = [], []
    for t in range(len(off) - 1):
        for a in range(int(off[t]), int(off[t + 1]), STRETCH):
            low, high = max(int(off[t]), a - 2 * WIDTH), min(int(off[t + 1]), a + STRETCH + 3 * WIDTH)
            _, x = select(raw[low:high], np.array([0, high - low]), rank)
            x = x[(x + low >= a) & (x + low < a + STRETCH)] + low
            doc.append(np.full(len(x), t))
            at.append(x)
    return np.concatenate(doc), np.concatenate(at)


def feature_hashes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for i in range(0, len(at), 1 << 14):
        w = np.ascontiguousarray(raw[at[i : i + (1 << 14), None] + np.arange(WIDTH)]).view(np.uint64)
        x = np.zeros(len(w), np.uint64)
        for k in range(w.shape[1]):
            with np.errstate(over="ignore"):
                x = mix64(x * np.uint64(31) + w[:, k])
        h[i : i + (1 << 14)] = x
    return h


def short_feature(raw: np.ndarray) -> np.ndarray:
    """The feature of a text shorter than a window: its bytes, filled up with bytes that UTF-8 never has."""
    filled = np.full(WIDTH, 0xFF, np.uint8)
    filled[: len(raw)] = raw
    return feature_hashes(filled, np.zeros(1, np.int64))


def bloom(features: np.ndarray) -> bytes:
    """Chained filters of 2048 bits, 160 features each, 5 bits a feature."""
    filters = np.zeros((-(-len(features) // FULL), BITS), np.uint8)
    for k in range(HASHES):
        filters[np.arange(len(features)) // FULL, ((features >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(filters, axis=1).tobytes()


def _features(col: pa.Array, rank: np.ndarray) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Ranges of rows and the distinct features of each of their texts, in order."""
    raw, off = column_bytes(col)
    for i, j in batches_of(raw, off, 1 << 18):
        part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        doc, at = selected(part, o, rank)
        h, lists = feature_hashes(part, at), []
        for t, x in enumerate(np.split(h, np.searchsorted(doc, np.arange(1, j - i)))):
            if not len(x) and 0 < o[t + 1] - o[t] < WIDTH:
                x = short_feature(part[o[t] : o[t + 1]])
            _, first = np.unique(x, return_index=True)
            lists.append(x[np.sort(first)])
        yield i, j, lists


def digest_class(n: int, digest: bytes) -> int:
    """Texts with the same digest of as many features are one class in the comparison, named by 64 bits of a hash."""
    return int.from_bytes(hashlib.blake2b(digest, digest_size=8, salt=n.to_bytes(8, "little")).digest(), "little", signed=True)


def _digests(rank: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, lists in _features(batch.column("text"), rank):
                blobs, sizes = [bloom(x) for x in lists], [len(x) for x in lists]
                names = [digest_class(n, d) for n, d in zip(sizes, blobs, strict=True)]
                cols = [batch.column("doc_id").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary()), pa.array(names, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "digest", "c"])

    return run


def _all_features(rank: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, lists in _features(batch.column("text"), rank):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).view(np.int64))], names=["f"])

    return run


def _posts(rank: np.ndarray, table: np.ndarray) -> Callable:
    """(feature, class) of the features whose bit is set in `table`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, lists in _features(batch.column("text"), rank):
                sizes = [len(x) for x in lists]
                names = np.array([digest_class(n, bloom(x)) for n, x in zip(sizes, lists, strict=True)], np.int64)
                f = np.concatenate(lists)
                bit = f & np.uint64(SHARED_BITS - 1)
                keep = (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                yield pa.RecordBatch.from_arrays([pa.array(f[keep].view(np.int64)), pa.array(np.repeat(names, sizes)[keep])], names=["f", "c"])

    return run


def _bits(shared: DataFrame) -> np.ndarray:
    """One bit for each value of the low bits of the features, as a table of SHARED_BITS bits whatever their number."""
    word = F.expr(f"CAST(f & {SHARED_BITS - 1} AS BIGINT)")
    words_ = shared.select(F.shiftright(word, 5).alias("at"), F.expr("shiftleft(1L, CAST(f & 31 AS INT))").alias("b")).groupBy("at").agg(F.bit_or("b").alias("b"))
    got = words_.toArrow()  # at most SHARED_BITS / 32 rows
    table = np.zeros(SHARED_BITS // 32, np.uint32)
    table[got["at"].to_numpy()] = got["b"].to_numpy().astype(np.uint32)
    return table.view(np.uint8)


def compare(a: bytes, na: int, b: bytes, nb: int) -> float:
    """Normalised bit overlap of two digests, 0 to 100.

    Each filter of the digest with fewer filters takes its best partner in the other; the score of two filters is
    where their common bits lie between what chance explains and the most that could be common.  Without features: 0.
    """
    if not na or not nb:
        return 0.0
    x, y = (np.unpackbits(np.frombuffer(d, np.uint8).reshape(-1, BITS // 8), axis=1) for d in (a, b))
    if len(x) > len(y):
        x, y, na, nb = y, x, nb, na
    cx, cy = (np.minimum(FULL, n - FULL * np.arange(len(f))) for n, f in ((na, x), (nb, y)))
    p = 1 - 1 / BITS
    common, most = (x.astype(np.int32) @ y.T.astype(np.int32)), np.minimum(x.sum(axis=1)[:, None], y.sum(axis=1)[None, :])
    ex, ey = p ** (HASHES * cx)[:, None], p ** (HASHES * cy)[None, :]
    chance = BITS * (1 - ex - ey + ex * ey)
    cut = 0.3 * (most - chance) + chance
    score = np.clip((common - cut) / np.maximum(most - cut, 1e-9), 0, 1)
    return round(float(score.max(axis=1).mean() * 100), 3)


def _runs(filters: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of digests of about `BLOCK` filters together, one digest at least."""
    ends, i = np.cumsum(filters), 0
    while i < len(filters):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK, side="right")))
        yield i, j
        i = j


def compare_all(a: list[bytes], na: np.ndarray, b: list[bytes], nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`compare(a[i], b[j])` and `compare(b[j], a[i])` of all pairs; they differ only where both have as many filters."""
    out, back = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))

    def prepare(d: list[bytes], n: np.ndarray) -> tuple:
        k = -(-n // FULL)
        start = np.cumsum(k) - k
        raw = np.frombuffer(b"".join(d), np.uint8).reshape(-1, BITS // 8)
        in_filter = np.minimum(FULL, np.repeat(n, k) - FULL * (np.arange(len(raw)) - np.repeat(start, k)))
        bits = np.unpackbits(raw, axis=1)
        return k, start, bits.astype(np.float32), bits.sum(axis=1, dtype=np.int64), (1 - 1 / BITS) ** (HASHES * in_filter)

    for i, j in _runs(-(-na // FULL)):
        ka, sa, xa, ones_a, ea = prepare(a[i:j], na[i:j])
        for k, m in _runs(-(-nb // FULL)):
            kb, sb, xb, ones_b, eb = prepare(b[k:m], nb[k:m])
            common, most = (xa @ xb.T).astype(np.float64), np.minimum(ones_a[:, None], ones_b[None, :])  # whole numbers to 2048: exact
            chance = BITS * (1 - ea[:, None] - eb[None, :] + ea[:, None] * eb[None, :])
            cut = 0.3 * (most - chance) + chance
            score = np.clip((common - cut) / np.maximum(most - cut, 1e-9), 0, 1)
            ab = np.add.reduceat(np.maximum.reduceat(score, sb, axis=1), sa, axis=0) / ka[:, None]
            ba = np.add.reduceat(np.maximum.reduceat(score, sa, axis=0), sb, axis=1) / kb[None, :]
            fewer, more = ka[:, None] < kb[None, :], ka[:, None] > kb[None, :]
            out[i:j, k:m], back[i:j, k:m] = np.where(more, ba, ab), np.where(fewer, ab, ba)
    return np.round(out * 100, 3), np.round(back * 100, 3)


def _matches(match: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                i, j = batch.column("i")[row].as_py(), batch.column("j")[row].as_py()
                m = batch.column("m")[row].values
                c, n, block, tells = (m.field(x).to_numpy(zero_copy_only=False) for x in ("c", "n", "block", "tells"))
                digests = m.field("digest").to_pylist()
                x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
                if not tells.any() or not len(x) or not len(y):
                    continue
                out, back = compare_all([digests[k] for k in x], n[x], [digests[k] for k in y], n[y])
                good = (np.maximum(out, back) >= match) & (tells[x][:, None] | tells[y][None, :])
                p, q = np.nonzero(np.triu(good, 1) if i == j else good)
                first = c[x[p]] < c[y[q]]  # a pair that meets again at another feature has to come out the same
                a, b = np.where(first, c[x[p]], c[y[q]]), np.where(first, c[y[q]], c[x[p]])
                ab, ba = np.where(first, out[p, q], back[p, q]), np.where(first, back[p, q], out[p, q])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ab), pa.array(ba)], names=["a", "b", "ab", "ba"])

    return run


def candidate_blocks(posts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, i, j, c, block, tells): the classes `c` of blocks i <= j of each set of classes that share a feature.

    posts: the distinct (f, c) of features that several classes may have; sizes: c, n (its features).
    A feature doesn't tell for a class if it is among the quarter (rounded down) of the class's features that most
    classes have (ties: the larger number).  Features with the same classes count once, by a signature of the set.
    No set is gathered: its classes go to blocks of about BLOCK by a hash.
    """
    salt = F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int").alias("salt")
    # counts are summed before the shuffle, and come back to the rows by a join on (f, salt): no feature is one task
    df = posts.groupBy("f").agg(F.count("*").alias("df")).filter("df > 1")
    spread = df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shared = posts.withColumn("salt", salt).join(spread, ["f", "salt"]).select("f", "c", "df")
    by_class = Window.partitionBy("c").orderBy(F.desc("df"), F.desc("f"))  # a document's features
    ranked = shared.withColumn("hot", F.row_number().over(by_class)).join(sizes, "c")
    ranked = materialize(ranked.select("f", "c", "df", (F.col("hot") > F.expr("n div 4")).alias("tells")), "shared")
    one = F.xxhash64("c", "tells")
    sets = ranked.groupBy("f").agg(F.min("df").alias("df"), F.bit_xor(one).alias("x"), F.bit_xor(F.xxhash64(one, F.lit(1))).alias("y"), F.max("tells").alias("some"))
    sets = sets.filter("some").groupBy("df", "x", "y").agg(F.min("f").alias("f"))
    sets = sets.select("f", F.ceil(F.col("df") / BLOCK).alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = ranked.withColumn("salt", salt).join(sets, ["f", "salt"]).withColumn("block", F.pmod(F.xxhash64("c", F.lit(7)), "blocks"))
    meet = members.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return meet.select(F.col("f").alias("id"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "c", "block", "tells")


def links(docs: DataFrame, match: float = MATCH) -> tuple[DataFrame, DataFrame]:
    """The digest and class of every document (doc_id, n, digest, c), and the linked pairs of classes (a, b, ab, ba)."""
    d = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    rank = rarity(d)
    made = materialize(in_arrow(d, _digests(rank), with_id(d, "n bigint, digest binary, c bigint")), "digests")
    # texts are read again for the features: they would take more room on disk than everything else
    seen = in_arrow(d.select("text"), _all_features(rank), "f bigint").groupBy("f").agg(F.count("*").alias("n"))
    posts = in_arrow(d.select("text"), _posts(rank, _bits(seen.filter("n > 1").select("f"))), "f bigint, c bigint")
    posts = materialize(posts.distinct(), "posts")
    classes = made.filter("n > 0").select("c", "n", "digest").dropDuplicates(["c"])
    meet = candidate_blocks(posts, classes.select("c", "n"))
    groups = meet.join(classes, "c").groupBy("id", "i", "j").agg(F.collect_list(F.struct("block", "c", "n", "digest", "tells")).alias("m"))
    pairs = in_arrow(groups.select("i", "j", "m"), _matches(match), "a bigint, b bigint, ab double, ba double").dropDuplicates(["a", "b"])
    return made, materialize(pairs, "pairs")


def fingerprints(docs: DataFrame, match: float = MATCH) -> DataFrame:
    """The digest of every document, the class of documents with the same digest, and the classes linked to it.

    One pass ranks entropy scores by how rare they are over all windows of all documents; further ones select
    features, hash them and fill the filters.  Documents with equal digests are one class.  Two classes are linked if
    they share a feature that tells for one of them (see `candidate_blocks`) and score at least `match`.  A pair that
    shares no such feature shares at most a quarter of either's features, which is below the share (0.3) that scores
    anything.  So a passage of many documents leads to comparisons only where it is a good part of a document.  Sets
    of classes are compared block by block, and digests move with the blocks, never with the pairs.

    Result: doc_id (of any type that sorts), n_features, digest (base64 of 256 bytes a filter), class_id (smallest
    doc_id of the class), n_copies (rows of the class), n_links (other classes linked), match_id and match_score (the
    class_id and score of the best linked class; ties: the smallest class_id).  The score of two classes is the larger
    of the two directions, if both have as many filters.
    A text under 64 bytes has one feature, its bytes.  Null and empty texts, and texts whose windows all score under
    100 (such as one repeated character), have no feature, an empty digest, are a class of their own (class_id:
    doc_id, n_copies: 1) and are linked to nothing.  Rows without doc_id are left out.  Rows that repeat a doc_id get
    a row each.  Texts of any length count whole.  An empty table gives an empty result.  Other columns are ignored,
    whatever their names.
    """
    made, pairs = links(docs, match)
    classes = made.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"))
    score = F.greatest("ab", "ba").alias("s")
    ends = pairs.select(F.col("a").alias("c"), F.col("b").alias("other"), score).unionByName(pairs.select(F.col("b").alias("c"), F.col("a").alias("other"), score))
    ends = ends.join(classes.select(F.col("c").alias("other"), F.col("class_id").alias("id")), "other")
    best = ends.groupBy("c").agg(F.count("*").alias("n_links"), F.min(F.struct((-F.col("s")).alias("s"), "id")).alias("best"))
    known = classes.join(best, "c", "left")
    out = made.join(known, (made["c"] == known["c"]) & (made["n"] > 0), "left")
    return out.select(
        "doc_id", F.col("n").cast("int").alias("n_features"), F.base64("digest").alias("digest"), F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("best.id").alias("match_id"), (-F.col("best.s")).alias("match_score"),
    )
