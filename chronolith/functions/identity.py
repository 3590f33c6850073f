"""Canonical text, canonical JSON and content-hash identities as column expressions.

ASCII values stay in generated code.  Only values with other characters, which need Unicode normalisation or JSON
escapes, pass through an Arrow UDF; the others reach it as nulls.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

INVISIBLE = "".join(map(chr, [*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, *range(0xFFF9, 0xFFFC)]))
_DROP = dict.fromkeys(map(ord, INVISIBLE))
_BLANK = "[\\s\\x0b\\x1c-\\x1f]+"


def canonical_text(value: str) -> str:
    """NFC, without invisible characters, lower case, white space runs as one space, none at the ends."""
    return " ".join(unicodedata.normalize("NFC", value).translate(_DROP).lower().split())


def json_text(value: str) -> str:
    return json.dumps(value)


def _each(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return F.pandas_udf(run, StringType())


def canonical(c: Column | str) -> Column:
    """`canonical_text` of a column; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.octet_length(c) == F.length(c)
    fast = F.lower(F.trim(F.regexp_replace(c, _BLANK, " ")))
    return F.when(plain, fast).otherwise(_each(canonical_text)(F.when(~plain, c)))


def json_string(c: Column) -> Column:
    """A JSON string literal in ASCII; null gives `null`."""
    plain = ~c.rlike("[^ -~]")
    fast = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.coalesce(F.when(plain, fast).otherwise(_each(json_text)(F.when(~plain, c))), F.lit("null"))


def iso(ts: Column) -> Column:
    """ISO 8601 in UTC; microseconds only when there are any."""
    micros = F.date_format(ts, "SSSSSS")
    tail = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), tail, F.lit("+00:00"))


def _time(ts: Column) -> Column:
    """As identities see it: strings are canonicalised again, so the T is small."""
    return F.coalesce(F.concat(F.lit('"'), F.lower(iso(ts)), F.lit('"')), F.lit("null"))


def content_hash(namespace: str, json_column: Column) -> Column:
    return F.sha2(F.concat(F.lit(namespace + ":"), json_column), 256)


def canonical_slots(slots: Column) -> Column:
    """Slots with canonical keys and values, in key order; keys that collapse with different values are an error."""
    plain = F.forall(F.map_entries(slots), lambda e: _is_ascii(e["key"]) & _is_ascii(F.coalesce(e["value"], F.lit(""))))
    pairs = F.array_distinct(F.transform(F.map_entries(slots), lambda e: F.struct(canonical_sql(e["key"]).alias("key"), canonical_sql(e["value"]).alias("value"))))
    fast = F.map_from_entries(F.array_sort(pairs))
    other = F.map_from_entries(F.array_sort(F.map_entries(_other_slots(F.when(~plain, slots)))))
    return F.when(plain, fast).otherwise(other)


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def slots_of(pairs: dict[str, str | None]) -> dict[str, str | None]:
    out: dict[str, str | None] = {}
    for key, value in pairs.items():
        k, v = canonical_text(key), None if value is None else canonical_text(value)
        if out.setdefault(k, v) != v:
            raise ValueError(f"slot {k!r} has two values")
    return out


@F.pandas_udf(MapType(StringType(), StringType()))
def _other_slots(s: pd.Series) -> pd.Series:
    """Slots with characters that need Unicode normalisation; others reach it as nulls."""
    return s.map(lambda m: None if m is None else slots_of(dict(m)))


def canonical_sql(c: Column) -> Column:
    """Canonical text inside lambdas, where no UDF may stand: exact for ASCII."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c, INVISIBLE, ""), "[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+", " ")))


def core_id(claim_type: Column, slots: Column) -> Column:
    """Identity of a core.  `slots` must come from `canonical_slots`; escapes beyond ASCII are made outside the lambda."""
    entry = F.transform(F.map_entries(slots), lambda e: F.concat(F.lit('"'), _escape(e["key"]), F.lit('":"'), _escape(e["value"]), F.lit('"')))
    raw = F.concat(F.lit('{"claim_type":"'), _escape(claim_type), F.lit('","slots":{'), F.array_join(entry, ","), F.lit("}}"))
    return content_hash("claim_core", _ascii(raw))


def _escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


_NOT_ASCII = re.compile(r"[^ -~]")
_SHORT = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _escape_char(m: re.Match) -> str:
    c = m.group()
    if c in _SHORT:
        return _SHORT[c]
    n = ord(c)
    return f"\\u{n:04x}" if n < 0x10000 else f"\\u{0xD800 + ((n - 0x10000) >> 10):04x}\\u{0xDC00 + ((n - 0x10000) & 0x3FF):04x}"


def ascii_json(raw: str) -> str:
    return _NOT_ASCII.sub(_escape_char, raw)


def _ascii(raw: Column) -> Column:
    plain = ~raw.rlike("[^ -~]")
    return F.when(plain, raw).otherwise(_each(ascii_json)(F.when(~plain, raw)))


def revision_id() -> Column:
    """Identity over the columns of a revision row (text columns canonical)."""
    return content_hash(
        "claim_revision",
        F.concat(
            F.lit('{"assertion":'), json_string(F.col("assertion")),
            F.lit(',"confidence_bp":'), F.col("confidence_bp").cast("string"),
            F.lit(',"core_id":'), json_string(F.col("core_id")),
            F.lit(',"provenance":{"evidence_ref":'), json_string(F.col("evidence_ref")),
            F.lit(',"source":'), json_string(F.col("source")),
            F.lit('},"status":'), json_string(F.col("status")),
            F.lit(',"transaction_time":{"recorded_at":'), _time(F.col("recorded_at")),
            F.lit(',"tx_id":'), F.col("tx_id").cast("string"),
            F.lit('},"valid_time":{"end":'), _time(F.col("vt_end")),
            F.lit(',"start":'), _time(F.col("vt_start")), F.lit("}}"),
        ),
    )


def relation_id() -> Column:
    """Identity over the columns of a relation row, endpoints in canonical order."""
    return content_hash(
        "relation_edge",
        F.concat(
            F.lit('{"from_revision_id":'), json_string(F.col("from_revision_id")),
            F.lit(',"relation_type":'), json_string(F.col("relation_type")),
            F.lit(',"to_revision_id":'), json_string(F.col("to_revision_id")),
            F.lit(',"transaction_time":{"recorded_at":'), _time(F.col("recorded_at")),
            F.lit(',"tx_id":'), F.col("tx_id").cast("string"), F.lit("}}"),
        ),
    )
