"""Multi-step retrieval: hops, chains, facets and answers, as short driver loops over top-k jobs.

Loops run a fixed number of steps over a handful of hits; the hits of all steps are bounded by k and the number of
steps, and only they reach the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import evidence, graph, search
from .search import Index


@dataclass(frozen=True)
class Hit:
    revision_id: str
    score: float
    text: str
    source: str


@dataclass
class Found:
    """What a retrieval gave: hits in order, by source, how it was found, and what belongs to its kind."""

    question: str
    hits: list[Hit]
    trace: list[str] = field(default_factory=list)
    parts: dict[str, list[Hit]] = field(default_factory=dict)
    chains: list[list[Hit]] = field(default_factory=list)
    topics: list[tuple[int, float]] = field(default_factory=list)
    themes: list[str] = field(default_factory=list)
    context: str = ""

    @property
    def sources(self) -> dict[str, list[Hit]]:
        out: dict[str, list[Hit]] = {}
        for h in self.hits:
            out.setdefault(h.source, []).append(h)
        return out

    def summary(self) -> str:
        lines = [f"{self.question}: {len(self.hits)} chunks from {len(self.sources)} sources", *self.trace]
        lines += [f"part {name!r}: {len(hits)}" for name, hits in self.parts.items()]
        lines += [f"chain of {len(c)}: " + " > ".join(h.source for h in c) for c in self.chains]
        lines += [f"themes: {', '.join(self.themes)}"] if self.themes else []
        return "\n".join(lines)

    def context_for_model(self, most: int = 10) -> str:
        return "\n\n".join(f"[{i}] ({h.source}) {h.text}" for i, h in enumerate(self.hits[:most], 1))


class Retriever:
    """Searches of one index at fixed coordinates."""

    def __init__(self, ix: Index, chunks: DataFrame, edges: DataFrame | None = None, clusters: DataFrame | None = None, tx_id: int | None = None, valid_at: str | None = None) -> None:
        self.ix, self.chunks, self.edges, self.clusters, self.at = ix, chunks, edges, clusters, (tx_id, valid_at)

    def hits(self, ranked: DataFrame) -> list[Hit]:
        rows = ranked.join(self.chunks.select("revision_id", "text", "source"), "revision_id").orderBy("rank").collect()
        return [Hit(r.revision_id, r.score, r.text, r.source) for r in rows]

    def query(self, questions: str | list[str], k: int) -> list[list[Hit]]:
        """The top k of each question, all in one job."""
        asked = [questions] if isinstance(questions, str) else questions
        if not asked or k < 1:
            return [[] for _ in asked]
        q = self.chunks.sparkSession.createDataFrame(list(enumerate(asked)), "qid long, text string")
        ranked = search.temporal_search(self.ix, self.chunks, q, k, *self.at)
        rows = ranked.join(self.chunks.select("revision_id", "text", "source"), "revision_id").orderBy("qid", "rank").collect()
        out: list[list[Hit]] = [[] for _ in asked]
        for r in rows:
            out[r.qid].append(Hit(r.revision_id, r.score, r.text, r.source))
        return out

    def rerank(self, question: str, hits: list[Hit]) -> list[Hit]:
        """The hits in the order of their scores for another question (ties: by id)."""
        if not hits:
            return []
        spark = self.chunks.sparkSession
        ids = spark.createDataFrame([(h.revision_id,) for h in hits], "revision_id string")
        scores = {r.revision_id: r.score for r in search.scores(self.ix, search.one(self.chunks, question), ids).collect()}
        new = [Hit(h.revision_id, round(scores.get(h.revision_id, 0.0), 6), h.text, h.source) for h in hits]
        return sorted(new, key=lambda h: (-h.score, h.revision_id))

    def key_terms(self, text: str, most: int) -> list[str]:
        rows = evidence.key_terms(search.one(self.chunks, text), most=most).orderBy("place").collect()
        return [r.term for r in rows]

    def near(self, ids: list[str], k: int) -> dict[str, list[tuple[str, float]]]:
        if self.edges is None or not ids:
            return {}
        rows = graph.neighbors(self.edges.filter(F.col("src").isin(ids)), self.chunks, k).orderBy("src", "rank").collect()
        out: dict[str, list[tuple[str, float]]] = {}
        for r in rows:
            out.setdefault(r.src, []).append((r.dst, r.score))
        return out

    def by_id(self, scored: dict[str, float]) -> list[Hit]:
        rows = self.chunks.filter(F.col("revision_id").isin(list(scored))).select("revision_id", "text", "source").collect()
        return [Hit(r.revision_id, scored[r.revision_id], r.text, r.source) for r in rows]


def reason(r: Retriever, question: str, k: int = 5, hops: int = 2, expand: int = 3) -> Found:
    """Hop 0 is the top k; each hop asks for up to `expand` new key terms of all that was found; the first score of a hit
    stays until all are ranked for the question.  Stops when a hop gives nothing new."""
    seen = {h.revision_id: h for h in r.query(question, k)[0]}
    trace, asked = [f"hop 0: {len(seen)} chunks"], {w for w in question.lower().split()}
    for hop in range(1, hops + 1):
        terms = [t for t in r.key_terms(" ".join(h.text for h in seen.values()), 2 * expand) if t not in asked][:expand] if seen else []
        asked.update(terms)
        new = {h.revision_id: h for found in r.query(terms, k) for h in found if h.revision_id not in seen} if terms else {}
        trace.append(f"hop {hop}: {', '.join(terms)}: {len(new)} new chunks")
        if not new:
            break
        seen |= new
    return Found(question, r.rerank(question, list(seen.values())), trace)


def discover(r: Retriever, seed: str, k: int = 5, depth: int = 2, least: float = 0.15) -> Found:
    """Level by level: the first ten words of each hit of a level are the questions of the next."""
    seen: dict[str, Hit] = {}
    frontier, trace = [seed], []
    for level in range(depth + 1):
        new = {h.revision_id: h for found in r.query(frontier, k) for h in found if h.score >= least and h.revision_id not in seen}
        trace.append(f"level {level}: {len(new)} new chunks")
        seen |= new
        frontier = [" ".join(h.text.split()[:10]) for h in list(new.values())[:k]]
        if not frontier:
            break
    return Found(seed, sorted(seen.values(), key=lambda h: (-h.score, h.revision_id)), trace)


def evidence_chain(r: Retriever, claim: str, k: int = 5, length: int = 5, least: float = 0.05) -> Found:
    """Direct hits, hits of the claim's key terms, and from three of the direct ones a walk along the best edges."""
    direct = [h for h in r.query(claim, k)[0] if h.score >= least]
    terms = r.key_terms(claim, 5)
    all_ = {h.revision_id: h for h in direct}
    for found in r.query(terms, k) if terms else []:
        for h in found:
            if h.score >= least:
                all_.setdefault(h.revision_id, h)
    chains = [[h] for h in direct[:3]]
    going = list(range(len(chains)))
    for _ in range(length - 1):
        near = r.near([chains[i][-1].revision_id for i in going], 3)
        steps = {}
        for i in going:
            been = {h.revision_id for h in chains[i]}
            good = [(d, s) for d, s in near.get(chains[i][-1].revision_id, []) if d not in been and s > least]
            if good:
                steps[i] = max(good, key=lambda x: x[1])
        if not steps:
            break
        known = {h.revision_id: h for h in r.by_id(dict(steps.values()))}
        going = [i for i in steps if steps[i][0] in known]
        for i in going:
            chains[i].append(known[steps[i][0]])
            all_[steps[i][0]] = chains[i][-1]
    ids = {h.revision_id for h in direct}
    hits = sorted(all_.values(), key=lambda h: (-h.score, h.revision_id))
    parts = {"supporting": [h for h in hits if h.revision_id in ids], "related": [h for h in hits if h.revision_id not in ids]}
    return Found(claim, hits, [f"key terms: {', '.join(terms)}"], parts, [c for c in chains if len(c) > 1])


_TWO = re.compile(r"(?:trade-?off|contrast|compare|comparison|difference)\s+(?:between\s+)?(.+?)\s+(?:versus|vs\.?|and)\s+(.+)")
_CHANGE = re.compile(r"how\s+(?:did|have|has)\s+(.+?)\s+(?:grow|progress|develop|change|evolve)")
_RELATED = re.compile(r"(?:connection|influence|effect|impact|relat\w*)\s+(?:to|on|of|between)\s+(.+?)\s+(?:with|to|on|and)\s+(.+)")
_CLAUSE = re.compile(r"[;,]\s*(?:and\s+)?(?=(?:who|when|where|which|why|what|how)\b)", re.I)
_JOINED = re.compile(r"\b(?:as\s+well\s+as|moreover|furthermore|additionally|also|but|or|and)\b", re.I)


def decompose(question: str, most: int = 5) -> list[str]:
    """The question, then its clauses, the two sides of a comparison or relation, past and present of a change, and the
    parts between conjunctions; each once, over five characters, `most` at most."""
    plain = question.strip().rstrip("?.,!")
    low = plain.lower()
    out = [question]
    clauses = _CLAUSE.split(plain)
    out += [c.strip() for c in clauses if len(c.strip()) > 15] if len(clauses) > 1 else []
    if m := _TWO.search(low):
        a, b = (x.strip() for x in m.groups())
        out += [x for x in (a, b) if len(x) > 3] + [f"{a} vs {b}"]
    if (m := _CHANGE.search(low)) and len(m.group(1)) > 3:
        out += [f"{m.group(1)} origins history", f"{m.group(1)} current state recent"]
    out += [p for p in (x.strip().rstrip("?.,!") for x in _JOINED.split(plain)) if len(p) > 15 and p.lower() != low]
    if m := _RELATED.search(low):
        out += [x.strip() for x in m.groups() if len(x.strip()) > 3]
    kept: dict[str, str] = {}
    for q in out:
        if len(q.strip()) > 5:
            kept.setdefault(q.lower().strip(), q)
    return list(kept.values())[:most]


def query_deep(r: Retriever, question: str, k: int = 5, most: int = 5) -> Found:
    """Sub-questions, the top k of each, their graph neighbours at half their score, and the clusters by their best hit."""
    asked = decompose(question, most)
    parts = dict(zip(asked, r.query(asked, k), strict=True))
    best: dict[str, float] = {}
    for hits in parts.values():
        for h in hits:
            best[h.revision_id] = max(best.get(h.revision_id, 0.0), h.score)
    direct = dict(best)
    for src, near in r.near(list(direct), 3).items():
        for dst, s in near:
            best.setdefault(dst, s * 0.5 * direct[src])
    hits = r.rerank(question, r.by_id(best)) if best else []
    topics = []
    if r.clusters is not None and best:
        rows = r.clusters.filter(F.col("revision_id").isin(list(best))).collect()
        top: dict[int, float] = {}
        for c in rows:
            top[c.cluster] = max(top.get(c.cluster, 0.0), best[c.revision_id])
        topics = sorted(top.items(), key=lambda x: (-x[1], x[0]))
    return Found(question, hits, [f"{len(asked)} sub-questions"], parts, topics=topics)


def diverse(hits: list[Hit], per_source: int = 3) -> list[Hit]:
    """Hits dealt round their sources, as `search.diversify` does for tables."""
    turn: dict[str, int] = {}
    best = {h.source: i for i, h in reversed(list(enumerate(hits)))}
    keyed = []
    for h in hits:
        turn[h.source] = turn.get(h.source, 0) + 1
        keyed.append((turn[h.source], best[h.source], h))
    return [h for n, _, h in sorted(keyed, key=lambda x: x[:2]) if n <= per_source]


def synthesize(r: Retriever, question: str, k: int = 10, window: int = 1, hops: int = 2, most_chars: int = 30000) -> Found:
    """Reasoned hits, dealt round the sources, each with its surroundings, up to a number of characters; and themes."""
    base = reason(r, question, k, hops)
    picked = diverse(base.hits)[:k]
    if not picked:
        return Found(question, [], base.trace)
    spark = r.chunks.sparkSession
    ranked = spark.createDataFrame([(0, h.revision_id, h.score, i) for i, h in enumerate(picked, 1)], "qid long, revision_id string, score double, rank int")
    hits = r.hits(search.with_context(ranked, r.chunks, window))
    blocks, used = [], 0
    for h in hits:
        block = f"[{h.source}]\n{h.text}"
        if used + len(block) > most_chars:
            break
        blocks.append(block)
        used += len(block)
    return Found(question, hits, base.trace, themes=r.key_terms(" ".join(h.text for h in hits), 10), context="\n\n".join(blocks))


def classify(r: Retriever, question: str) -> str:
    return search.one(r.chunks, question).select(tx.question_kind("text").alias("k")).first().k


def ask(r: Retriever, question: str, k: int = 10, strategy: str = "auto") -> Found:
    """Retrieval by the kind of question: factual (top hits and their surroundings), comparison (each side, then both),
    multi-aspect (each part), exploratory (hops)."""
    kind = classify(r, question) if strategy == "auto" else strategy
    if kind == "exploratory":
        out = reason(r, question, k)
    elif kind in ("comparison", "multi-aspect"):
        asked = decompose(question)
        parts = dict(zip(asked, r.query(asked, max(1, k // len(asked) + 1)), strict=True))
        first: dict[str, Hit] = {}
        for hits in parts.values():
            for h in hits:
                first.setdefault(h.revision_id, h)
        out = Found(question, diverse(r.rerank(question, list(first.values())))[:k], parts=parts)
    elif kind == "factual":
        top = r.query(question, max(1, k // 2))[0]
        if top:
            spark = r.chunks.sparkSession
            ranked = spark.createDataFrame([(0, h.revision_id, h.score, i) for i, h in enumerate(top, 1)], "qid long, revision_id string, score double, rank int")
            top = r.hits(search.with_context(ranked, r.chunks, 1))[:k]
        out = Found(question, top)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    out.trace.insert(0, f"strategy: {kind}")
    return out


def answer(r: Retriever, question: str, k: int = 10, hops: int = 2, most: int = 5, least: float = 0.1) -> dict:
    """Sentences that answer a question, with a confidence of their mean score, their number and their sources."""
    kind = classify(r, question)
    hits = r.query(question, k)[0] if kind == "factual" else reason(r, question, k, hops).hits[:k]
    out = {"question": question, "kind": kind, "sentences": [], "confidence": 0.0, "sources": len({h.source for h in hits})}
    if not hits:
        return out
    spark = r.chunks.sparkSession
    ranked = spark.createDataFrame([(0, h.revision_id, h.score, i) for i, h in enumerate(hits, 1)], "qid long, revision_id string, score double, rank int")
    rows = evidence.answers(evidence.answer_sentences(ranked, r.chunks, search.one(r.chunks, question), least), most).orderBy("place").collect()
    of = {h.revision_id: h.source for h in hits}
    out["sentences"] = [{"text": x.sentence, "score": x.score, "source": of[x.revision_id]} for x in rows]
    if rows:
        mean = sum(x.score for x in rows) / len(rows)
        out["confidence"] = round(mean * 0.5 + min(len(rows) / most, 1) * 0.3 + min(out["sources"] / 3, 1) * 0.2, 3)
    return out
