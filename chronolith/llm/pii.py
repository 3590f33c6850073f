"""Personal data: offset-preserving deobfuscation, detection, and spans in the characters of the source."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bytesops import ASCII_VALUE, batches_of, column_bytes, words
from .common import in_arrow, with_id

# One source character for one target character: offsets stay as they are.
HOMOGLYPHS = str.maketrans(
    "АВЕЅІЈКМНОРСТХУаеѕіјорсхуԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοιρνκ․。．＠ⓐ‐‑‒–—−⁻（）＋／：",
    "ABESIJKMHOPCTXYaesijopcxydhABEZHIKMNOPTYXaoipvk...@a-------()+/:",
) | {0xFF10 + i: 48 + i for i in range(10)} | {0xFF21 + i: 65 + i for i in range(26)} | {0xFF41 + i: 97 + i for i in range(26)} | {
    z + i: 48 + i for z in (0x0660, 0x06F0, 0x0966) for i in range(10)
} | {z: 32 for z in (0xA0, 0x2002, 0x2003, 0x2007, 0x2009, 0x202F, 0x3000)}

_NAMES = {
    "zero": 0, "oh": 0, "null": 0, "zéro": 0, "cero": 0, "one": 1, "eins": 1, "un": 1, "uno": 1, "two": 2, "zwei": 2,
    "deux": 2, "dos": 2, "three": 3, "drei": 3, "trois": 3, "tres": 3, "four": 4, "vier": 4, "quatre": 4, "cuatro": 4,
    "five": 5, "fünf": 5, "cinq": 5, "cinco": 5, "six": 6, "sechs": 6, "seis": 6, "seven": 7, "sieben": 7, "sept": 7,
    "siete": 7, "eight": 8, "acht": 8, "huit": 8, "ocho": 8, "nine": 9, "neun": 9, "neuf": 9, "nueve": 9,
}
_DIGIT = "(?:" + "|".join(sorted(_NAMES, key=len, reverse=True)) + ")"
# A run of spelled digits, at least three, with single digits among them.
_SPELLED = re.compile(rf"(?<!\w){_DIGIT}(?:[ ,._-]{{1,2}}(?:{_DIGIT}|\d)(?!\w)){{2,}}", re.I)
_DIGIT_OR = re.compile(rf"{_DIGIT}(?!\w)|\d", re.I)
_AT, _DOT = "at|arroba|arobase|klammeraffe|ät", "dot|punto|punkt|point|period"
_SIGN = re.compile(
    rf"(?P<at>\s?[\[({{<]\s?(?:{_AT}|@)\s?[\])}}>]\s?)|(?P<dot>\s?[\[({{<]\s?(?:{_DOT}|\.)\s?[\])}}>]\s?)"
    rf"|(?P<bat>(?<=\w)\s(?:{_AT})\s(?=[\w-]+(?:\s?[\[({{<]?\s?(?:{_DOT})\s?[\])}}>]?\s?|\.)[a-z]{{2,}})(?![\w.+-]*\s?@))|(?P<bdot>(?<=\w)\s(?:{_DOT})\s(?=\w))"
    rf"|(?P<sat>(?<=\w)\s@\s?(?=[\w-]+(?:\.|\s(?:{_DOT})\s|\s?[\[({{<]))|(?<=\w)@\s(?=[\w-]+\.))",
    re.I,
)

_LOCAL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
_CARD = re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,}")
# At every digit of such a run; a number without separators counts as a whole.
_CARD_SHAPE = re.compile(r"(?=((?<!\d)\d{13,19}(?!\d)|\d{4}([ -])\d{4}\2\d{4}\2\d{4}|\d{4}([ -])\d{6}\3\d{5}))")
_ISSUER = re.compile(r"4|5[1-5]|3[0-9]|6|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)")
_SSN = re.compile(r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])")
_PHONE = re.compile(
    r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]?\d{4}|\d{3}([ .-])\d{3}\1\d{4})(?!\w|\.\d)"
)
_SPELLED_PHONE = re.compile(r"\d{7,15}")
_SECRET = re.compile(r"""(?<![\w])(?:api[_ -]?key|secret|token|passw(?:or)?d|access[_ -]?key)\w*["']?\s*[=:]\s*["']?([\w+/=-]{16,})""", re.I)

# What a text may hold, decided on its bytes for many texts at once; a text without any of it is never decoded.
ODD, SPELLED, SIGN, AT, DIGIT, SECRET = (1 << i for i in range(6))
EVERYTHING = ODD | SPELLED | SIGN | AT | DIGIT | SECRET
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[sorted({chr(c).encode()[0] for c in HOMOGLYPHS})] = True
# blanks and digits of any script count for \s and \d
_ODD_LEAD[sorted({c.encode()[0] for c in map(chr, range(128, sys.maxunicode + 1)) if c.isspace() or c.isdigit()})] = True
# letters above 127 that re.IGNORECASE takes for an ASCII one, where the lead alone doesn't tell
_CASE_PAIRS = ((0xC5, 0xBF), (0xC4, 0xB0), (0xC4, 0xB1))


def _parts(name: str) -> list[int]:
    """Hashes of the ASCII pieces of a name: letters above 127 separate them, whatever their case."""
    raw = np.frombuffer(name.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]), ASCII_VALUE)[0].tolist()


_NAME_PARTS = [_parts(w) for w in _NAMES]
_WHOLE_NAMES = np.sort(np.array([p[0] for p in _NAME_PARTS if len(p) == 1], np.uint64))
_CUT_NAMES = [p for p in _NAME_PARTS if len(p) == 2]  # as in f-nf
_ONE_DIGIT = np.sort(np.array([_parts(str(d))[0] for d in range(10)], np.uint64))
_AT_LENGTH = {_parts(w)[-1]: len(re.split(r"[^a-z]", w)[-1]) for w in _AT.split("|")}
_AT_WORDS = np.array(list(_AT_LENGTH), np.uint64)
_DOT_WORDS = np.array([_parts(w)[0] for w in _DOT.split("|")], np.uint64)


def hints(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text, which of the searches can find something in it; never too few."""
    n = len(off) - 1
    out = np.zeros(n, np.int64)
    if not len(raw):
        return out

    def texts(where: np.ndarray) -> np.ndarray:
        return np.searchsorted(off, np.flatnonzero(where), side="right") - 1

    out[texts(_ODD_LEAD[raw])] |= EVERYTHING
    digit = (raw >= 48) & (raw <= 57)
    out[texts(digit)] |= DIGIT
    out[texts(raw == 64)] |= AT | SIGN
    assigned = np.zeros(n, bool)
    assigned[texts((raw == 61) | (raw == 58))] = True
    out[assigned & (out & DIGIT > 0)] |= SECRET
    for x, y in _CASE_PAIRS:
        out[texts((raw[:-1] == x) & (raw[1:] == y))] |= EVERYTHING
    mark = (raw == 91) | (raw == 40) | (raw == 123) | (raw == 60)
    out[texts(mark)] |= SIGN
    # words end at any character above 127: no word that a search can mean is missed, some are found that aren't one
    h, doc, start = words(raw, off, ASCII_VALUE)
    if len(h):
        spelled = np.isin(h, _WHOLE_NAMES)
        for p, q in _CUT_NAMES:
            half = np.flatnonzero((h[:-1] == p) & (h[1:] == q) & (doc[:-1] == doc[1:]))
            spelled[half] = spelled[half + 1] = True
        any_digit = spelled | np.isin(h, _ONE_DIGIT)
        run = any_digit[:-2] & any_digit[1:-1] & any_digit[2:] & (spelled[:-2] | spelled[1:-1] | spelled[2:]) & (doc[:-2] == doc[2:])
        out[doc[:-2][run]] |= SPELLED
        out[doc[np.isin(h, _DOT_WORDS)]] |= SIGN
        # a bare "at" counts where the run of characters behind it and a blank has a dot before the next blank
        at = np.flatnonzero(np.isin(h, _AT_WORDS))
        if len(at):
            dots = np.append(np.flatnonzero(raw == 46), 1 << 62)
            blanks = np.append(np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13)) | ((raw >= 28) & (raw <= 31))), 1 << 62)
            behind = start[at] + np.array([_AT_LENGTH[x] for x in h[at].tolist()]) + 1
            end = np.minimum(blanks[np.searchsorted(blanks, behind)], off[doc[at] + 1])
            out[doc[at[dots[np.searchsorted(dots, behind)] < end]]] |= SIGN
    return out


def _luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    total = sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])
    return total > 0 and total % 10 == 0


def _cards(run: str) -> list[tuple[int, int]]:
    """Spans of the cards in a run of digits and separators, best first; other numbers may stand right beside them.

    Overlapping ones are all listed: those that neither begin nor end inside a number come first, then those with the
    first digits of a card issuer, then the leftmost.
    """
    found = []
    for y in _CARD_SHAPE.finditer(run):
        a, b = y.span(1)
        if _luhn(re.sub(r"\D", "", y.group(1))):
            whole = not run[max(a - 1, 0) : a].isdigit() and not run[b : b + 1].isdigit()
            found.append((not whole, not _ISSUER.match(run, a), a, b))
    return [x[2:] for x in sorted(found)]


class Mapped:
    """A normalised text and the way back to the characters of its source."""

    def __init__(self, text: str) -> None:
        self.text, self.to, self.source, self.kind = text, [0], [0], [0]  # kind 1: rewritten, maps as a whole
        self.size = len(text)

    def rewrite(self, changes: list[tuple[int, int, str]]) -> Mapped:
        """Replace disjoint, rising spans of the normalised text; maps are composed."""
        out, at = [], 0
        to, source, kind = [], [], []
        n = 0

        def copy(a: int, b: int) -> None:
            nonlocal n
            while a < b:
                i = bisect_right(self.to, a) - 1
                e = min(b, self.to[i + 1] if i + 1 < len(self.to) else self.size)
                to.append(n)
                kind.append(self.kind[i])
                source.append(self.source[i] if self.kind[i] else self.source[i] + a - self.to[i])
                out.append(self.text[a:e])
                n += e - a
                a = e

        for a, b, new in changes:
            copy(at, a)
            if new:
                to.append(n)
                source.append(self.back(a, b)[0])
                kind.append(1)
                out.append(new)
                n += len(new)
            at = b
        copy(at, self.size)
        m = Mapped("".join(out))
        # the end of a rewritten piece is where the next piece starts in the source
        m.to, m.source, m.kind, m.last = to or [0], source or [0], kind or [0], getattr(self, "last", self.size)
        m.size = n
        return m

    def back(self, a: int, b: int) -> tuple[int, int]:
        """Source span of the normalised span [a, b), a < b."""
        i, j = bisect_right(self.to, a) - 1, bisect_right(self.to, b - 1) - 1
        start = self.source[i] if self.kind[i] else self.source[i] + a - self.to[i]
        if not self.kind[j]:
            return start, self.source[j] + b - self.to[j]
        return start, self.source[j + 1] if j + 1 < len(self.source) else getattr(self, "last", self.size)


def normalise(text: str, may: int = EVERYTHING) -> Mapped:
    """Undo homoglyphs (one for one), spelled digits, and disguises of @ and dots."""
    m = Mapped(text.translate(HOMOGLYPHS) if may & ODD and not text.isascii() else text)
    runs = may & SPELLED and [(x.start(), x.end(), "".join(str(_NAMES.get(d.lower(), d)) for d in _DIGIT_OR.findall(x.group()))) for x in _SPELLED.finditer(m.text)]
    if runs:
        m = m.rewrite(runs)
    if may & SIGN:
        signs = [(x.start(), x.end(), "@" if x.lastgroup in ("at", "bat", "sat") else ".") for x in _SIGN.finditer(m.text)]
        m = m.rewrite(signs) if signs else m
    return m


def find(text: str, may: int = EVERYTHING) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised value) of every identifier, in source characters, without overlaps.

    Kinds, the first taking precedence on overlap: email, ip, card (13 to 19 digits with a valid check digit, wherever
    it stands in a run of digits and separators; of overlapping ones the best by `_cards`), ssn, phone, secret (a long
    value assigned to a name like api_key).
    """
    m = normalise(text, may)
    t, found = m.text, []
    ends: list[int] = []  # of the spans found, which are disjoint and in order

    def add(kind: str, a: int, b: int) -> None:
        i = bisect_right(ends, a)
        if i == len(found) or b <= found[i][1]:
            found.insert(i, (kind, a, b))
            ends.insert(i, b)

    at = t.find("@")
    while at >= 0:
        d, a = _DOMAIN.match(t, at), at
        while a and t[a - 1] in _LOCAL:
            a -= 1
        while a < at and not t[a].isalnum():
            a += 1
        if d and a < at:
            add("email", a, d.end())
        at = t.find("@", at + 1)
    if may & (DIGIT | SPELLED):
        for x in _IP.finditer(t):
            add("ip", *x.span())
        for x in _CARD.finditer(t):
            for a, b in _cards(x.group()):
                add("card", x.start() + a, x.start() + b)
        for kind, rule in (("ssn", _SSN), ("phone", _PHONE)):
            for x in rule.finditer(t):
                if kind == "ssn" or 7 <= sum(c.isdigit() for c in x.group()) <= 15:
                    add(kind, *x.span())
        for i, k in enumerate(m.kind):
            if k and _SPELLED_PHONE.fullmatch(t[m.to[i] : (m.to[i + 1] if i + 1 < len(m.to) else m.size)]):
                add("phone", m.to[i], m.to[i + 1] if i + 1 < len(m.to) else m.size)
    if may & SECRET:
        for x in _SECRET.finditer(t):
            if any(c.isdigit() for c in x.group(1)):
                add("secret", *x.span(1))
    return [(kind, *m.back(a, b), t[a:b]) for kind, a, b in found]


def mask(text: str, may: int = EVERYTHING) -> str:
    """The text with every identifier replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b, _ in find(text, may):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]]) if at else text


def _suspects(column: pa.Array) -> tuple[np.ndarray, list[str], list[int]]:
    """Position, text and hints of the texts that may hold something."""
    raw, off = column_bytes(column)
    may = np.concatenate([hints(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in batches_of(raw, off)] or [np.zeros(0, np.int64)])
    at = np.flatnonzero(may)
    return at, column.take(pa.array(at)).to_pylist(), may[at].tolist()


def _find_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        at, texts, may = _suspects(batch.column("text"))
        rows = [(i, *x, t[x[1] : x[2]]) for i, t, h in zip(at.tolist(), texts, may, strict=True) for x in find(t, h)]
        of, *cols = list(zip(*rows, strict=True)) or [[]] * 6
        ids = batch.column("doc_id").take(pa.array(of, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], names=["doc_id", "kind", "start", "end", "value", "found"])


def pii(docs: DataFrame) -> DataFrame:
    """Every identifier of every document, also where it is disguised.

    Transducers rewrite homoglyphs one for one, runs of spelled digits (four languages) and 'at' / 'dot' disguises,
    and keep for each piece of the normalised text where it comes from; detectors run on the normalised text, and
    their spans are mapped back.  One pass, no shuffle.  A byte scan of whole
    batches first tells which searches can find something in a text; it never tells too few.

    Result: doc_id (of any type), kind, start, end (characters of the text, end exclusive), value (normalised), found (as written).
    Null and empty texts have none.  A null doc_id is kept.  Repeated rows are searched each for itself; spans of one
    text don't overlap (the kind that comes first in `find` wins).  A text of any length is searched whole, in time that
    grows with its length and identifiers.  An empty table gives an empty result.  Other
    columns are ignored, whatever their names.
    """
    d = docs.select("doc_id", "text").filter("text IS NOT NULL")
    return in_arrow(d, _find_rows, with_id(d, "kind string, start bigint, end bigint, value string, found string"))


def mask_documents(docs: DataFrame) -> DataFrame:
    """`docs`, all columns, with identifiers masked in `text`, and `n_chars` (if there) counted anew for masked rows.

    Null, empty and clean texts, ids of any kind, repeated rows and all other columns stay as they are; texts of any
    length are masked whole; an empty table gives an empty result.
    """
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            where, texts, may = _suspects(cols[at])
            new = [mask(t, h) for t, h in zip(texts, may, strict=True)]
            hit = [(i, b) for i, a, b in zip(where.tolist(), texts, new, strict=True) if a is not b]
            if hit:
                flags = np.zeros(batch.num_rows, bool)
                flags[[i for i, _ in hit]] = True
                chosen = pa.array(flags)
                cols[at] = pc.replace_with_mask(cols[at], chosen, pa.array([b for _, b in hit], cols[at].type))
                if size is not None:
                    cols[size] = pc.replace_with_mask(cols[size], chosen, pa.array([len(b) for _, b in hit], cols[size].type))
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return in_arrow(docs, run, docs.schema)
