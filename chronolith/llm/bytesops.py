"""Vectorised byte and word hashing over Arrow string columns.

Every function works on the raw UTF-8 bytes of a column, so a batch costs a fixed number of NumPy passes and no
Python object per word.  Words are maximal runs of ASCII letters, digits and characters above 127 other than the
punctuation and blanks of U+0080-U+00BF, U+2000-U+206F and U+3000-U+303F; ASCII upper case is folded.  Long texts are
walked in pieces, and a word across pieces is hashed as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes hashed at once; a longer text is walked in pieces of about this size
_P = 0x9E3779B97F4A7C15 | 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    fold = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        if b > 127 or c.isalnum():
            fold[b] = ord(c.lower()) if b < 128 else b
    value = mix64(fold.astype(np.uint64) + np.uint64(1))
    value[fold == 0] = 0
    return fold, value


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, element by element."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


FOLD, VALUE = _tables()
ASCII_VALUE = np.where(np.arange(256) < 128, VALUE, np.uint64(0))  # all that isn't ASCII separates words
_cache: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, enough for one piece."""
    if "p" not in _cache:
        n = 2 * PIECE
        with np.errstate(over="ignore"):
            up = np.full(n, _P, dtype=np.uint64)
            up[0] = 1
            down = np.full(n, pow(_P, -1, 1 << 64), dtype=np.uint64)
            down[0] = 1
            _cache["p"], _cache["q"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _cache["p"], _cache["q"]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its values; null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def pieces(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE bytes that end where a text, a word or, in a longer word, a character ends."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            k = int(off[np.searchsorted(off, end, side="right") - 1])
            if k > at:
                end = k
            else:
                gaps = np.flatnonzero(FOLD[raw[at:end]] == 0)
                end = at + int(gaps[-1]) + 1 if len(gaps) else end
                while end > at + 1 and raw[end] & 0xC0 == 0x80:
                    end -= 1
        yield at, end
        at = end


def blank_marks(r: np.ndarray, v: np.ndarray) -> None:
    """Set the values of punctuation and blanks above 127 to 0."""
    for lead, second in ((0xC2, ()), (0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        at = np.flatnonzero(r[:-1] == lead)
        if not len(at):
            continue
        if second:
            at = at[np.isin(r[at + 1], second)]
            v[np.minimum(at + 2, len(v) - 1)] = 0
        v[at] = v[at + 1] = 0


def words(raw: np.ndarray, off: np.ndarray, value: np.ndarray = VALUE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and start byte of every word of the column, in order; bytes of `value` 0 separate words."""
    up, down = _powers()
    hashes, starts = [], []
    for a, b in pieces(raw, off):
        v = value[raw[a:b]]
        if value is VALUE:
            blank_marks(raw[a:b], v)
        is_word = v != 0
        first = is_word.copy()
        first[1:] &= ~is_word[:-1]
        low = int(np.searchsorted(off, a))
        cut = off[low : np.searchsorted(off, b)] - a  # a text starts a word of its own
        first[cut] |= is_word[cut]
        s = np.flatnonzero(first)
        if not len(s):
            on = False
            continue
        with np.errstate(over="ignore"):
            v *= up[: b - a]
            h = np.add.reduceat(v, s) * down[s]
            if starts and on and s[0] == 0 and off[low] != a:  # the word before the cut goes on
                hashes[-1][-1] += h[0] * np.uint64(pow(_P, a - int(starts[-1][-1]), 1 << 64))
                h, s = h[1:], s[1:]
        on = bool(is_word[-1])
        if len(s):
            hashes.append(h)
            starts.append(s + a)
    if not hashes:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    h, s = mix64(np.concatenate(hashes)), np.concatenate(starts)
    return h, np.searchsorted(off, s, side="right") - 1, s


def batches_of(raw: np.ndarray, off: np.ndarray, limit: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together, one text at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def word_hash(word: str) -> int:
    """The hash that `words` gives to one word; of a name that isn't one word, the first."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    h, _, _ = words(raw, np.array([0, len(raw)]))
    return int(h[0]) if len(h) else 0
