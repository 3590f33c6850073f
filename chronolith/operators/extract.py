"""Claims and chunks from text, and entities from mentions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import identity as ident
from .corpus import CHUNK
from .search import small_batches

SIZE, OVERLAP, LEAST = 800, 150, 10
_PARAGRAPH, _SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+")


def chunk_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Chunks of about `size` characters: paragraphs, or the sentences of longer ones, are put together in order.

    A join counts as one character though it is two.  Chunks under `least` are dropped; then each but the first gets
    the end of the one before (`overlap` characters at most, from a word's start).  A sentence is never cut.
    """
    parts: list[str] = []
    for p in filter(None, map(str.strip, _PARAGRAPH.split(text or ""))):
        parts += [p] if len(p) <= size else [s.strip() for s in _SENTENCE.split(p) if s.strip()]
    groups: list[list[str]] = []
    room = 0
    for p in parts:
        if groups and len(p) + 1 <= room:
            groups[-1].append(p)
        else:
            groups.append([p])
            room = size
        room -= len(p) + 1
    plain = [c for c in map("\n\n".join, groups) if len(c) >= least]
    if overlap <= 0:
        return plain
    return plain[:1] + [f"{_tail(a, overlap)}\n\n{b}" for a, b in zip(plain, plain[1:])]


def _tail(text: str, n: int) -> str:
    end = text[-n:]
    at = end.find(" ")
    return end[at + 1 :] if at > 0 else end


def chunked(text: Column, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunk_text(t, size, overlap, least) or ([t.strip()] if t and t.strip() else []))

    return F.pandas_udf(run, ArrayType(StringType()))(text)


def chunk_claims(texts: DataFrame, tx_id: int, now: Column, confidence_bp: int = 5000, **sizes: int) -> DataFrame:
    """Claims for `facts.assert_revisions` from texts (source, text, optionally vt_start): one a chunk.

    A text that gives no chunk is one, if it isn't blank.  Slots: source, chunk_idx and the first 200 characters.
    """
    small_batches(texts.sparkSession)  # texts are of any length, and so are their chunks
    start = F.col("vt_start") if "vt_start" in texts.columns else now
    d = texts.select("source", start.alias("vt_start"), F.posexplode(chunked(F.col("text"), **sizes)).alias("i", "chunk"))
    slots = F.create_map(F.lit("source"), "source", F.lit("chunk_idx"), F.col("i").cast("string"), F.lit("text"), F.substring("chunk", 1, 200))
    return d.select(
        F.lit(CHUNK).alias("claim_type"), slots.alias("slots"), F.col("chunk").alias("assertion"), "vt_start", F.lit(None).cast("timestamp").alias("vt_end"), F.lit(tx_id).cast("long").alias("tx_id"),
        now.alias("recorded_at"), "source", F.concat(F.lit("chunk "), F.col("i").cast("string")).alias("evidence_ref"), F.lit(confidence_bp).alias("confidence_bp"), F.lit("asserted").alias("status"),
    )


def regex_claims(texts: DataFrame, patterns: dict[str, tuple[str, list[str]]], key: str = "doc_id") -> DataFrame:
    """key, claim_type, slots, evidence_ref: a claim for each match of each pattern (expression, names of its groups).

    Names take the groups in order; slot values are canonical.  Expressions are Java's.
    """
    out = None
    for kind, (rule, names) in patterns.items():
        groups = [F.regexp_extract_all("text", F.lit(rule), F.lit(g)) for g in range(len(names) + 1)]
        d = texts.select(key, F.explode(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)])).alias("m"))
        slots = ident.canonical_slots(F.create_map(*[x for i, n in enumerate(names, 1) for x in (F.lit(n), F.col(f"m.g{i}"))]))
        d = d.select(key, F.lit(kind).alias("claim_type"), slots.alias("slots"), F.col("m.g0").alias("evidence_ref"), F.concat(F.lit("regex:"), F.lit(kind)).alias("provenance"))
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise ValueError("no pattern")
    return out


def model_claims(texts: DataFrame, model: Callable[[str], str], key: str = "doc_id") -> DataFrame:
    """key, claim_type, slots, error from a model that answers with JSON: an object or a list of {claim_type, slots}.

    What isn't JSON gives one row with an error; items without type or slots are left out.
    """

    def ask(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str:
            try:
                got = json.loads(model(t or ""))
            except ValueError as e:
                return json.dumps([{"error": str(e)}])
            got = got if isinstance(got, list) else [got]
            good = [x for x in got if isinstance(x, dict) and x.get("claim_type") and isinstance(x.get("slots"), dict) and x["slots"]]
            return json.dumps([{"claim_type": x["claim_type"], "slots": {k: str(v) for k, v in x["slots"].items()}} for x in good])

        return s.map(one)

    answer = F.pandas_udf(ask, StringType())(F.col("text"))
    rows = F.from_json(answer, "array<struct<claim_type:string,slots:map<string,string>,error:string>>")
    return texts.select(key, F.explode(rows).alias("x")).select(key, "x.claim_type", "x.slots", "x.error")


def resolve_exact(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """mention, entity_id, confidence_bp (10000), method by canonical surface; aliases: surface, entity_id (the first in order counts)."""
    known = aliases.groupBy(ident.canonical("surface").alias("k")).agg(F.min("entity_id").alias("entity_id"))
    return mentions.withColumn("k", ident.canonical("mention")).join(known, "k", "left").select(
        *mentions.columns, "entity_id", F.when(F.col("entity_id").isNotNull(), 10000).alias("confidence_bp"), F.when(F.col("entity_id").isNotNull(), "exact").alias("method")
    )


def resolve_normalized(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mention, entity_id, confidence_bp, method; entities: name, entity_id.

    The same canonical name counts 9500.  Else the first name in order whose words hold, or are held by, the mention's
    counts 7000.  Candidates share a word (an equi-join on words); counts of shared words decide, so nothing is paired
    that shares none.
    """
    split = lambda c: F.array_distinct(F.filter(F.split(ident.canonical(c), " "), lambda w: w != ""))
    names = entities.groupBy(ident.canonical("name").alias("name")).agg(F.min("entity_id").alias("entity_id"))
    m = mentions.select("mention").distinct().withColumn("k", ident.canonical("mention"))
    a = m.select("mention", F.explode(split("k")).alias("word"), F.size(split("k")).alias("n"))
    b = names.select("name", "entity_id", F.explode(split("name")).alias("word"), F.size(split("name")).alias("m"))
    held = a.join(b, "word").groupBy("mention", "name", "entity_id", "n", "m").agg(F.count("*").alias("c")).filter("c = n OR c = m")
    part = held.groupBy("mention").agg(F.min(F.struct("name", "entity_id")).alias("part"))
    same = m.join(names.withColumnRenamed("name", "k"), "k").select("mention", F.col("entity_id").alias("same"))
    d = mentions.join(same, "mention", "left").join(part, "mention", "left")
    bp = F.when(F.col("same").isNotNull(), 9500).when(F.col("part").isNotNull(), 7000)
    return d.select(*mentions.columns, F.coalesce("same", "part.entity_id").alias("entity_id"), bp.alias("confidence_bp"), F.when(bp.isNotNull(), "normalized").alias("method"))


def resolve_cascade(mentions: DataFrame, *resolved: DataFrame) -> DataFrame:
    """The first answer of several resolvers, in order; each is (mention, entity_id, confidence_bp, method)."""
    d, got = mentions, []
    for i, r in enumerate(resolved):
        d = d.join(r.select("mention", F.struct("entity_id", "confidence_bp", "method").alias(f"r{i}")).dropDuplicates(["mention"]), "mention", "left")
        got.append(F.when(F.col(f"r{i}.entity_id").isNotNull(), F.col(f"r{i}")))
    best = F.coalesce(*got)
    return d.select(*mentions.columns, best["entity_id"].alias("entity_id"), best["confidence_bp"].alias("confidence_bp"), best["method"].alias("method"))


def alias_claims(decisions: DataFrame) -> DataFrame:
    """Decisions as claims: claim_type, slots (surface, entity, method)."""
    d = decisions.filter("entity_id IS NOT NULL")
    slots = F.create_map(F.lit("surface"), "mention", F.lit("entity"), F.col("entity_id").cast("string"), F.lit("method"), "method")
    return d.select(F.lit("internal.entity_alias@v1").alias("claim_type"), ident.canonical_slots(slots).alias("slots"), "confidence_bp")
