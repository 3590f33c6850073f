"""Registered queries over chunks, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables as tb
from ..functions import text as tx
from ..operators import corpus, evidence, extract, graph, reports, search

T, T0, V = tb.T_CHUNKS, tb.T_BEFORE, tb.V_CHUNKS
NOW = "2024-06-01"
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


STOP, NEG = _list(tx.STOP), _list(tx.NEGATIONS)
CHUNKS = r"""lines AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, idx, text
  FROM (SELECT doc_id, source, unnest(range(len(p))) AS idx, unnest(p) AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))
  WHERE regexp_matches(text, '[^ \t\r]')
), ch AS MATERIALIZED (
  SELECT *, CASE WHEN doc_id % 5 = 0 THEN vt_start + INTERVAL 700 DAY END AS vt_end FROM (
    SELECT sha256('chunk:' || doc_id || ':' || idx) AS revision_id, sha256('chunkcore:' || doc_id || ':' || idx) AS core_id, source, doc_id * 100000 + idx AS chunk_idx,
           CAST(idx // 3 AS INT) AS page_start, text, TIMESTAMP '2020-01-01' + (doc_id % 1500) * INTERVAL 1 DAY AS vt_start, doc_id % 50 AS tx_id,
           TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR AS recorded_at, CAST((doc_id * 37 + idx * 101) % 10001 AS INT) AS confidence_bp, doc_id FROM lines)
), live AS MATERIALIZED (SELECT * FROM ch WHERE doc_id % 11 <> 0),
cl AS (SELECT revision_id, CAST(doc_id % 50 AS INT) AS cluster FROM ch WHERE doc_id % 13 <> 0)"""
INDEX = rf"""tok AS (SELECT revision_id, list_filter({WORDS.format("text")}, lambda x: NOT list_contains({STOP}, x)) AS t FROM live),
tf AS MATERIALIZED (SELECT revision_id, term, count(*) AS tf FROM (
  SELECT revision_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tok) GROUP BY ALL),
voc AS MATERIALIZED (SELECT term, df, ln((1 + (SELECT count(*) FROM live)) / (1.0 + df)) + 1 AS idf FROM (
  SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term ORDER BY total DESC, term LIMIT {search.FEATURES})),
post AS MATERIALIZED (SELECT revision_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY revision_id)) AS w FROM (
  SELECT revision_id, term, (1 + ln(tf)) * idf AS x FROM tf JOIN voc USING (term)))"""
ASKED = rf"""q AS (SELECT item_id AS qid, text FROM benchmark),
qtok AS (SELECT qid, list_filter({WORDS.format("text")}, lambda x: NOT list_contains({STOP}, x)) AS t FROM q),
qtf AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM qtok) GROUP BY ALL),
qpost AS (SELECT qid, term, x / sqrt(sum(x * x) OVER (PARTITION BY qid)) AS wq FROM (SELECT qid, term, (1 + ln(tf)) * idf AS x FROM qtf JOIN voc USING (term))),
sc AS MATERIALIZED (SELECT qid, revision_id, round(sum(wq * w), 6) AS score FROM qpost JOIN post USING (term) GROUP BY ALL)"""


def _known(t: int, v: str) -> str:
    return f"""SELECT * FROM ch WHERE tx_id <= {t} AND vt_start <= TIMESTAMP '{v}' AND (vt_end IS NULL OR TIMESTAMP '{v}' < vt_end) AND NOT (doc_id % 11 = 0 AND tx_id + 5 <= {t})"""


def _top(k: int, source: str = "sc", name: str = "hits", least: str = "score > 0", where: str = "true") -> str:
    return f"""{name} AS MATERIALIZED (SELECT qid, revision_id, score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, revision_id) AS rank FROM {source} WHERE {least} AND {where}) WHERE rank <= {k})"""


def _hits(k: int) -> str:
    return f"WITH {CHUNKS}, {INDEX}, {ASKED}, {_top(k)}"


BASE = f"WITH {CHUNKS}"
CHARS = """vec AS (SELECT id, list_transform(range(32), lambda i: coalesce(m[i], 0) / n) AS v FROM (
  SELECT id, map(list(p), list(c)) AS m, sqrt(sum(c * c)) AS n FROM (SELECT id, p, CAST(count(*) AS DOUBLE) AS c FROM (
    SELECT id, unicode(unnest(regexp_extract_all(lower(text), '(?s).'))) % 32 AS p FROM ({0})) GROUP BY ALL) GROUP BY id))"""
CHAR_SCORES = (
    CHARS.format("SELECT revision_id AS id, text FROM live").replace("vec AS", "cv AS", 1)
    + ", "
    + CHARS.format("SELECT CAST(item_id AS VARCHAR) AS id, text FROM benchmark").replace("vec AS", "qv AS", 1)
    + ", csc AS (SELECT CAST(qv.id AS BIGINT) AS qid, cv.id AS revision_id, round(list_inner_product(qv.v, cv.v), 6) AS score FROM qv, cv)"
)
PAIRS = """pairs AS MATERIALIZED (SELECT a.revision_id AS a, b.revision_id AS b, round(sum(a.w * b.w), 6) AS score
  FROM (SELECT * FROM post JOIN cl USING (revision_id)) a JOIN (SELECT * FROM post JOIN cl USING (revision_id)) b
    ON a.term = b.term AND a.cluster = b.cluster AND a.revision_id < b.revision_id GROUP BY ALL HAVING round(sum(a.w * b.w), 6) >= 0.15),
edges AS MATERIALIZED (SELECT * FROM (SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM (
  SELECT a AS src, b AS dst, score FROM pairs UNION ALL SELECT b, a, score FROM pairs)) WHERE rank <= 10)"""
PLACED = "placed AS MATERIALIZED (SELECT revision_id, source, row_number() OVER (PARTITION BY source ORDER BY chunk_idx, revision_id) AS pos FROM live)"
EXPANDED = """expanded AS (SELECT h.qid, h.revision_id AS seed, n.revision_id, CAST(n.pos - p.pos AS INT) AS off, CASE WHEN n.pos = p.pos THEN h.score ELSE h.score / 2 END AS score, h.rank
  FROM hits h JOIN placed p USING (revision_id) JOIN placed n ON n.source = p.source AND n.pos BETWEEN p.pos - {0} AND p.pos + {0})"""
SIGNALS = (
    "least(10000, CASE WHEN list_has_any(wa, {neg}) <> list_has_any(wb, {neg}) THEN 2000 ELSE 0 END + 3000 * ({opp}) + CASE WHEN len(da) > 0 AND len(db) > 0 AND da <> db"
    " AND len(list_filter(list_intersect(wa, wb), lambda x: NOT list_contains({neg}, x))) > 5 THEN 1500 ELSE 0 END + CASE WHEN similarity > 0.4 THEN 1000 ELSE 0 END)"
).format(neg=NEG, opp=" + ".join(f"CAST((list_contains(wa, '{x}') AND list_contains(wb, '{y}')) OR (list_contains(wa, '{y}') AND list_contains(wb, '{x}')) AS INT)" for x, y in tx.OPPOSITES))
_NUM = r"list_sort(list_distinct(regexp_extract_all({0}, '\b\d+(?:\.\d+)?%?')))"


def _count(side: str) -> str:
    return " + ".join(f"CAST(contains(lower({side}.text), '{m}') AS INT)" for m in evidence.MARKERS)


def _any(side: str) -> str:
    return " OR ".join(f"contains(lower({side}.text), '{m}')" for m in evidence.CONTRASTS)


PATTERNS = {"email": (r"([a-z0-9._]+)@([a-z0-9-]+)\.(?:com|org|net)", ["user", "host"]), "number": (r"\b(\d+)\.(\d+)\b", ["whole", "part"])}


def queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    C, IX, CL, Q, H, HL, E = tb.written_chunks, tb.index, tb.clusters, tb.questions, tb.hits, tb.hit_lines, tb.edges

    def live(s: SparkSession, d: str) -> DataFrame:
        return corpus.active(C(s, d))

    def char_hits(s: SparkSession, d: str, k: int) -> DataFrame:
        v = search.character_vectors(32)
        return search.vector_search(live(s, d).select("revision_id", v(F.col("text")).alias("v")), Q(s, d).select("qid", v(F.col("text")).alias("v")), k)

    def exact(s: SparkSession, d: str) -> DataFrame:
        p = tb.load(s, d, "part")
        mentions = p.select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).otherwise(F.col("p_type")).alias("mention"), "p_partkey")
        return extract.resolve_exact(mentions, p.select(F.col("p_name").alias("surface"), F.col("p_partkey").alias("entity_id"))).select("p_partkey", "entity_id", "confidence_bp", "method")

    def subset(s: SparkSession, d: str) -> DataFrame:
        p = tb.load(s, d, "part")
        mentions = p.select(F.concat_ws(" ", "p_name", F.lit("of"), "p_type").alias("mention")).unionByName(p.select(F.col("p_type").alias("mention"))).distinct()
        return extract.resolve_normalized(mentions, p.select(F.col("p_type").alias("name"), F.col("p_type").alias("entity_id")))

    def asked(s: SparkSession, d: str) -> DataFrame:
        forms = ("what is %", "compare % with others", "why does % matter", "% and x and y", "explain %", "the trend of %", "%", "tell me all that there is to know of % now please")
        form = F.element_at(F.array(*map(F.lit, forms)), F.col("n_nationkey") % 8 + 1)
        return tb.load(s, d, "nation").select("n_nationkey", tx.question_kind(F.replace(form, F.lit("%"), F.col("n_name"))).alias("kind"))

    def decisions(s: SparkSession, d: str) -> DataFrame:
        y = tb.load(s, d, "labels").select((F.col("doc_id") % 40).cast("string").alias("entity"), F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("decision"), (F.col("doc_id") % 7).alias("tx_id"), F.col("doc_id").alias("revision_id"))
        return reports.latest_decisions(y)

    def now():
        return F.lit(NOW).cast("timestamp")

    show = {"timeline": ["qid", "place", "revision_id", "tx_id", "confidence_bp"]}
    out: dict[str, tuple] = {
        "tfidf_terms": (
            lambda s, d: IX(s, d).postings.groupBy("term").agg(F.count("*").alias("n"), F.round(F.sum("w"), 5).alias("weight")),
            f"WITH {CHUNKS}, {INDEX} SELECT term, count(*) AS n, round(sum(w), 5) AS weight FROM post GROUP BY term",
        ),
        "tfidf_topk": (lambda s, d: search.search(IX(s, d), Q(s, d), 5), f"{_hits(5)} SELECT * FROM hits"),
        "temporal_topk": (
            lambda s, d: search.temporal_search(IX(s, d), tb.lines(s, d), Q(s, d), 5, T, V),
            f"WITH {CHUNKS}, {INDEX}, {ASKED}, kn AS ({_known(T, V)}), {_top(5, where='revision_id IN (SELECT revision_id FROM kn)')} SELECT * FROM hits",
        ),
        "cosine_topk": (
            lambda s, d: search.vector_search(
                tb.load(s, d, "embeddings").select(F.col("vec_id").alias("revision_id"), F.col("embedding").cast("array<double>").alias("v")),
                tb.load(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("v")), 5),
            f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM v),
sc AS (SELECT q.id AS qid, c.id AS revision_id, round(list_inner_product(q.v, c.v) / (q.n * c.n), 6) AS score FROM n q JOIN n c ON q.id % 20 = 0), {_top(5, least='true')} SELECT * FROM hits""",
        ),
        "character_topk": (lambda s, d: char_hits(s, d, 5), f"WITH {CHUNKS}, {CHAR_SCORES}, {_top(5, 'csc', least='true')} SELECT * FROM hits"),
        "rrf_hybrid": (
            lambda s, d: search.fuse(H(s, d, 25), char_hits(s, d, 25), 5),
            f"""{_hits(25)}, {CHAR_SCORES}, {_top(25, 'csc', 'dense', 'true')},
f AS (SELECT qid, revision_id, round(0.5 / (60 + coalesce(h.rank - 1, 25)) + 0.5 / (60 + coalesce(e.rank - 1, 25)), 6) AS score FROM hits h FULL JOIN dense e USING (qid, revision_id)), {_top(5, 'f', 'fused')} SELECT * FROM fused""",
        ),
        "by_source": (lambda s, d: search.by_source(C(s, d), "SRC1", None).drop("core_id"), f"{BASE} SELECT revision_id, source, chunk_idx, 1.0::DOUBLE AS score FROM live WHERE contains(lower(source), 'src1')"),
        "by_source_asof": (lambda s, d: search.by_source(C(s, d), "src1", None, T, V).select("revision_id", "source"), f"{BASE} SELECT revision_id, source FROM ({_known(T, V)}) WHERE contains(lower(source), 'src1')"),
        "grouped_by_source": (
            lambda s, d: search.group_by_source(H(s, d, 20), HL(s, d, 20)).withColumn("hits", F.array_join("hits", ",")),
            f"{_hits(20)} SELECT qid, source, string_agg(revision_id, ',' ORDER BY rank) AS hits, max(score) AS best FROM hits JOIN ch USING (revision_id) GROUP BY ALL",
        ),
        "source_diversify": (
            lambda s, d: search.diversify(H(s, d, 20), HL(s, d, 20)),
            f"""{_hits(20)}, a AS (SELECT h.*, source, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY qid, source) AS best FROM hits h JOIN ch USING (revision_id))
SELECT qid, revision_id, source, score, row_number() OVER (PARTITION BY qid ORDER BY turn, best) AS rank FROM a WHERE turn <= 3""",
        ),
        "context_window": (
            lambda s, d: search.expand(H(s, d, 3), C(s, d), 2),
            f'{_hits(3)}, {PLACED}, {EXPANDED.format(2)} SELECT qid, seed, revision_id, off AS "offset", score FROM expanded',
        ),
        "query_with_context": (
            lambda s, d: search.with_context(H(s, d, 3), C(s, d), 1),
            f"""{_hits(3)}, {PLACED}, {EXPANDED.format(1)}, f AS (SELECT *, row_number() OVER (PARTITION BY qid, revision_id ORDER BY rank, off) AS n FROM expanded)
SELECT qid, revision_id, score, row_number() OVER (PARTITION BY qid ORDER BY f.rank, off) AS rank FROM f WHERE n = 1""",
        ),
        "timeline": (
            lambda s, d: search.timeline(H(s, d, 20), HL(s, d, 20)).select(*show["timeline"]),
            f"{_hits(20)} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY recorded_at, revision_id) AS place, revision_id, tx_id, confidence_bp FROM hits JOIN ch USING (revision_id)",
        ),
        "timeline_diff": (
            lambda s, d: search.timeline_diff(IX(s, d), tb.lines(s, d), Q(s, d), T0, T, 20),
            f"""WITH {CHUNKS}, {INDEX}, {ASKED}, ka AS ({_known(T0, '2099-01-01')}), kb AS ({_known(T, '2099-01-01')}),
{_top(20, name='ha', where='revision_id IN (SELECT revision_id FROM ka)')}, {_top(20, name='hb', where='revision_id IN (SELECT revision_id FROM kb)')}
SELECT qid, revision_id, CASE WHEN hb.score IS NULL THEN 'a' WHEN ha.score IS NULL THEN 'b' ELSE 'both' END AS side FROM ha FULL JOIN hb USING (qid, revision_id)""",
        ),
        "evolution": (
            lambda s, d: search.evolution(H(s, d, 20), HL(s, d, 20)).select("qid", "place", "revision_id", "source"),
            f"{_hits(20)} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY vt_start, revision_id) AS place, revision_id, source FROM hits JOIN ch USING (revision_id)",
        ),
        "coverage": (
            lambda s, d: search.coverage(H(s, d, 20), HL(s, d, 20)),
            f"{_hits(20)} SELECT *, count(*) OVER (PARTITION BY qid) AS sources FROM (SELECT qid, source, count(*) AS chunks, max(score) AS best FROM hits JOIN ch USING (revision_id) GROUP BY ALL)",
        ),
        "provenance": (
            lambda s, d: search.provenance(H(s, d, 5), HL(s, d, 5)).select("qid", "rank", "source", "page_start", "chunk_idx", "confidence_bp", "tx_id", "error"),
            f"{_hits(5)} SELECT qid, rank, source, page_start, chunk_idx, confidence_bp, tx_id, NULL::VARCHAR AS error FROM hits JOIN ch USING (revision_id)",
        ),
        "citations": (
            lambda s, d: search.cite_results(H(s, d, 20), HL(s, d, 20)).select("qid", "rank", "citation"),
            f"""{_hits(20)} SELECT qid, rank, '[' || source || ', p.' || page_start || ']' AS citation FROM (
  SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS n FROM hits JOIN ch USING (revision_id)) WHERE n = 1""",
        ),
        "citations_full": (
            lambda s, d: search.cite_results(H(s, d, 5), HL(s, d, 5), "full", once=False).select("qid", "rank", "citation"),
            f"""{_hits(5)} SELECT qid, rank, 'Source: ' || source || ' | Page: ' || page_start || ' | Chunk: ' || chunk_idx || ' | Confidence: ' || confidence_bp || '/10000 | Ingested: ' || strftime(recorded_at, '%Y-%m-%d') AS citation
FROM hits JOIN ch USING (revision_id)""",
        ),
        "explain_hits": (
            lambda s, d: evidence.explain(IX(s, d), H(s, d, 5), Q(s, d), HL(s, d, 5)).select("qid", "revision_id", F.array_join("shared", " ").alias("shared"), F.size("missing").alias("missing"), "ratio"),
            f"""{_hits(5)}, a AS (SELECT h.qid, h.revision_id, list_distinct(qtok.t) AS asked, list_distinct(tok.t) AS w FROM hits h JOIN qtok USING (qid) JOIN tok USING (revision_id))
SELECT qid, revision_id, array_to_string(list_sort(list_intersect(asked, w)), ' ') AS shared, CAST(len(asked) - len(list_intersect(asked, w)) AS INT) AS missing,
       round(len(list_intersect(asked, w)) / greatest(len(asked), 1), 3) AS ratio FROM a""",
        ),
        "confidence": (
            lambda s, d: evidence.confidence(H(s, d, 10), HL(s, d, 10), Q(s, d), now()),
            f"""{_hits(10)}, c AS (SELECT qid, list_has_any({WORDS.format("text")}, {NEG}) AS turned FROM q),
g AS (SELECT qid, count(h.revision_id) AS evidence, count(DISTINCT source) AS sources, count(*) FILTER (WHERE list_has_any({WORDS.format("text")}, {NEG}) = turned) AS supporting,
      coalesce(avg(greatest(0, 1 - floor((epoch(TIMESTAMP '{NOW}') - epoch(recorded_at)) / 86400) / 1825)), 0) AS recency FROM c LEFT JOIN hits h USING (qid) LEFT JOIN ch USING (revision_id) GROUP BY qid),
b AS (SELECT *, CASE WHEN evidence = 0 THEN 0 ELSE CAST(least(10000, least(sources * 1000, 3000) + least(evidence * 400, 2000) + floor(supporting / greatest(evidence, 1) * 3000 + 1e-9) + floor(round(recency * 2000, 6))) AS BIGINT) END AS confidence_bp FROM g)
SELECT qid, confidence_bp, evidence, sources, supporting, evidence - supporting AS contradicting, round(recency, 3) AS recency,
       CASE WHEN evidence < 2 THEN 'insufficient' WHEN confidence_bp >= 7000 THEN 'high' WHEN confidence_bp >= 4000 THEN 'medium' ELSE 'low' END AS assessment FROM b""",
        ),
        "contradictions": (
            lambda s, d: evidence.contradictions(IX(s, d), H(s, d, 20), HL(s, d, 20)),
            f"""{_hits(20)}, h AS (SELECT qid, rank, revision_id, source FROM hits JOIN ch USING (revision_id)),
p AS (SELECT a.qid, a.revision_id AS a, b.revision_id AS b FROM h a JOIN h b ON a.qid = b.qid AND a.rank < b.rank AND a.source <> b.source),
dots AS (SELECT a, b, round(sum(x.w * y.w), 6) AS similarity FROM (SELECT DISTINCT a, b FROM p) JOIN post x ON x.revision_id = a JOIN post y ON y.revision_id = b AND x.term = y.term GROUP BY ALL),
near AS (SELECT qid, a, b, similarity FROM p JOIN dots USING (a, b) WHERE similarity >= 0.15),
allp AS (SELECT * FROM near UNION ALL SELECT qid, a, b, 0.5 FROM p WHERE qid NOT IN (SELECT qid FROM near)),
t AS (SELECT allp.*, list_distinct({WORDS.format("x.text")}) AS wa, list_distinct({WORDS.format("y.text")}) AS wb, {_NUM.format("x.text")} AS da, {_NUM.format("y.text")} AS db
      FROM allp JOIN ch x ON x.revision_id = a JOIN ch y ON y.revision_id = b)
SELECT * FROM (SELECT qid, a, b, similarity, CAST({SIGNALS} AS INT) AS confidence_bp FROM t) WHERE confidence_bp > 0""",
        ),
        "answer_sentences": (
            lambda s, d: evidence.answer_sentences(H(s, d, 10), HL(s, d, 10), Q(s, d)).select("qid", "revision_id", "i", "score"),
            rf"""{_hits(10)}, qq AS (SELECT qid, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{3,}}'), lambda x: NOT list_contains({STOP}, x))) AS q FROM q),
s0 AS (SELECT qid, revision_id, rank, regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM hits JOIN ch USING (revision_id)),
s1 AS (SELECT qid, revision_id, rank, unnest(range(len(p))) AS i, trim(unnest(p)) AS sentence FROM s0),
s AS (SELECT *, regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]{{3,}}') AS w, count(*) OVER (PARTITION BY qid) AS n, avg(len(regexp_split_to_array(sentence, '\s+'))) OVER (PARTITION BY qid) AS length
      FROM s1 JOIN qq USING (qid) WHERE length(sentence) >= 20 AND len(q) > 0),
e AS (SELECT *, unnest(list_intersect(q, list_distinct(w))) AS term FROM s),
d AS (SELECT qid, term, count(*) AS df FROM e GROUP BY ALL),
g AS (SELECT qid, revision_id, rank, i, any_value(q) AS q, any_value(w) AS w, any_value(n) AS n,
      sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / greatest(length, 1)))) AS bm25
      FROM (SELECT e.*, df, len(list_filter(w, lambda x: x = term)) AS tf FROM e JOIN d USING (qid, term)) GROUP BY qid, revision_id, rank, i),
k AS (SELECT *, list_filter(list_distinct(w), lambda x: NOT list_contains({STOP}, x)) AS known FROM g)
SELECT * FROM (SELECT qid, revision_id, CAST(i AS INT) AS i, round((0.8 * least(bm25 / greatest(len(q) * ln(n + 1) * 2.2, 1), 1)
   + 0.2 * least(len(list_filter(known, lambda x: NOT list_contains(q, x))) / greatest(len(known), 1), 0.8)) / (1 + 0.1 * (rank - 1)), 4) AS score FROM k) WHERE score >= 0.1""",
        ),
        "similarity_edges": (lambda s, d: E(s, d), f"WITH {CHUNKS}, {INDEX}, {PAIRS} SELECT src, dst, score, rank FROM edges"),
        "neighbors": (lambda s, d: graph.neighbors(E(s, d), C(s, d)).select("src", "dst"), f"WITH {CHUNKS}, {INDEX}, {PAIRS} SELECT src, dst FROM edges WHERE rank <= 5"),
        "graph_totals": (
            lambda s, d: graph.totals(E(s, d), CL(s, d)),
            f"WITH {CHUNKS}, {INDEX}, {PAIRS} SELECT (SELECT count(*) FROM cl) AS nodes, (SELECT count(DISTINCT cluster) FROM cl) AS clusters, (SELECT count(*) FROM edges) AS edges",
        ),
        "cluster_labels": (
            lambda s, d: graph.labels(IX(s, d), CL(s, d)).withColumn("terms", F.array_join("terms", "|")),
            f"""WITH {CHUNKS}, {INDEX}, z AS (SELECT cluster, count(*) AS size FROM cl GROUP BY ALL),
m AS (SELECT cluster, size, term, row_number() OVER (PARTITION BY cluster ORDER BY round(s / size, 9) DESC, term) AS r FROM (SELECT cluster, term, sum(w) AS s FROM post JOIN cl USING (revision_id) GROUP BY ALL) JOIN z USING (cluster))
SELECT cluster, size, string_agg(term, '|' ORDER BY r) AS terms FROM m WHERE r <= 5 GROUP BY ALL""",
        ),
        "deduplicate": (
            lambda s, d: graph.deduplicate(IX(s, d), tb.lines(s, d)),
            f"""WITH RECURSIVE {CHUNKS}, {INDEX}, firsts AS MATERIALIZED (SELECT revision_id, min(revision_id) OVER (PARTITION BY text) AS f FROM live),
pp AS MATERIALIZED (SELECT post.* FROM post JOIN firsts USING (revision_id) WHERE f = revision_id),
near AS MATERIALIZED (SELECT a.revision_id AS a, b.revision_id AS b FROM pp a JOIN pp b ON a.term = b.term AND a.revision_id < b.revision_id GROUP BY ALL HAVING round(sum(a.w * b.w), 6) >= 0.85),
sym AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), reach AS (SELECT DISTINCT a, a AS b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON sym.a = reach.b),
root AS (SELECT a AS f, min(b) AS root FROM reach GROUP BY a), size AS (SELECT f, count(*) AS n FROM firsts GROUP BY f)
SELECT revision_id, coalesce(root, f) AS root FROM firsts JOIN size USING (f) LEFT JOIN root USING (f) WHERE n > 1 OR root IS NOT NULL""",
        ),
        "scan_contradictions": (
            lambda s, d: evidence.scan_contradictions(E(s, d), C(s, d)),
            f"""WITH {CHUNKS}, {INDEX}, {PAIRS}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE rank <= 5),
c AS (SELECT u.a, u.b, abs(({_count('x')}) - ({_count('y')})) AS d, ({_any('x')} OR {_any('y')}) AS contrast, abs(date_diff('day', x.vt_start, y.vt_start)) > 365 AS apart
      FROM u JOIN live x ON x.revision_id = a JOIN live y ON y.revision_id = b WHERE x.source <> y.source)
SELECT * FROM (SELECT a, b, round(CASE WHEN d >= 2 THEN 0.4 WHEN d = 1 THEN 0.2 ELSE 0 END + CASE WHEN contrast THEN 0.3 ELSE 0 END + CASE WHEN apart THEN 0.1 ELSE 0 END, 1)::DOUBLE AS score FROM c) WHERE score >= 0.2""",
        ),
        "compare_sources": (
            lambda s, d: evidence.compare_sources(E(s, d), C(s, d), 0.3),
            f"""WITH {CHUNKS}, {INDEX}, {PAIRS}, z AS (SELECT source, count(*) AS n FROM live GROUP BY ALL)
SELECT x.source AS source_a, y.source AS source_b, count(DISTINCT src) AS overlapping, any_value(n) AS chunks_a, round(100 * count(DISTINCT src) / any_value(n), 1) AS overlap_pct
FROM edges JOIN live x ON x.revision_id = src JOIN live y ON y.revision_id = dst JOIN z ON z.source = x.source WHERE x.source <> y.source AND score >= 0.3 GROUP BY ALL""",
        ),
        "list_sources": (
            lambda s, d: reports.list_sources(C(s, d)).withColumn("first_ingested", F.unix_timestamp("first_ingested")),
            f"{BASE} SELECT source, count(*) AS chunks, min(page_start) AS first_page, max(page_start) AS last_page, count(DISTINCT page_start) AS pages, CAST(epoch(min(recorded_at)) AS BIGINT) AS first_ingested FROM live GROUP BY source",
        ),
        "source_detail": (
            lambda s, d: reports.source_detail(C(s, d), CL(s, d)),
            f"""{BASE} SELECT *, short > 0.3 * chunks AS many_short, clusters = 1 AS one_cluster FROM (
SELECT source, count(*) AS chunks, CAST(min(length(text)) AS INT) AS shortest, CAST(max(length(text)) AS INT) AS longest, round(avg(length(text)), 6) AS average, count(DISTINCT cluster) AS clusters,
       count(*) FILTER (WHERE length(text) < 100) AS short, min(CAST(page_start AS VARCHAR)) AS first_page, max(CAST(page_start AS VARCHAR)) AS last_page FROM live LEFT JOIN cl USING (revision_id) GROUP BY source)""",
        ),
        "quality_flags": (
            lambda s, d: reports.quality_flags(C(s, d), CL(s, d)),
            f"""{BASE}, a AS (SELECT live.*, cluster FROM live LEFT JOIN cl USING (revision_id))
SELECT * FROM (SELECT 'short_chunks' AS issue, '' AS subject, count(*) AS count FROM a WHERE length(text) < 50 UNION ALL SELECT 'long_chunks', '', count(*) FROM a WHERE length(text) > 2000
UNION ALL SELECT 'orphan_chunks', '', count(*) FROM a WHERE cluster IS NULL UNION ALL SELECT 'low_confidence', '', count(*) FROM a WHERE confidence_bp < 3000
UNION ALL SELECT 'single_source_cluster', CAST(cluster AS VARCHAR), count(*) FROM a WHERE cluster IS NOT NULL GROUP BY cluster HAVING count(DISTINCT source) = 1
UNION ALL SELECT 'source_imbalance', source, count(*) FROM a GROUP BY source HAVING count(*) > 0.5 * (SELECT count(*) FROM a) AND (SELECT count(DISTINCT source) FROM a) > 1) WHERE count > 0""",
        ),
        "quality_by_source": (
            lambda s, d: reports.quality_by_source(C(s, d), CL(s, d)),
            f"{BASE} SELECT source, count(*) AS chunks, CAST(round(avg(length(text)), 0) AS BIGINT) AS average, CAST(min(length(text)) AS INT) AS shortest, CAST(max(length(text)) AS INT) AS longest, count(DISTINCT cluster) AS clusters FROM live LEFT JOIN cl USING (revision_id) GROUP BY source",
        ),
        "profile_sources": (
            lambda s, d: reports.profile_sources(C(s, d), CL(s, d)),
            f"{BASE} SELECT source, count(*) AS chunks, count(DISTINCT cluster) AS clusters, round(count(*) / (SELECT count(*) FROM live), 6) AS fraction FROM live LEFT JOIN cl USING (revision_id) GROUP BY source ORDER BY chunks DESC, source LIMIT 20",
        ),
        "profile_clusters": (
            lambda s, d: reports.profile_clusters(C(s, d), CL(s, d)).withColumns({"top_sources": F.array_join("top_sources", ","), "samples": F.array_join("samples", ",")}),
            f"""{BASE}, a AS (SELECT * FROM live JOIN cl USING (revision_id)), p AS (SELECT cluster, source, count(*) AS n FROM a GROUP BY ALL),
s AS (SELECT cluster, string_agg(source, ',' ORDER BY r) AS top_sources FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, source) AS r FROM p) WHERE r <= 3 GROUP BY cluster),
m AS (SELECT cluster, string_agg(revision_id, ',' ORDER BY r) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY source, chunk_idx, revision_id) AS r FROM a) WHERE r <= 3 GROUP BY cluster)
SELECT cluster, CAST(sum(n) AS BIGINT) AS size, count(*) AS sources, any_value(top_sources) AS top_sources, any_value(samples) AS samples, count(*) = 1 AS single_source, max(n) > 0.8 * sum(n) AS dominated
FROM p JOIN s USING (cluster) JOIN m USING (cluster) GROUP BY cluster""",
        ),
        "repeated_sentences": (
            lambda s, d: reports.repeated_sentences(C(s, d), None),
            rf"""{BASE}, s AS (SELECT DISTINCT source, trim(regexp_replace(lower(x), '[ \t\r\n\f]+', ' ', 'g')) AS sentence FROM (
  SELECT source, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')) AS x FROM live))
SELECT sentence, count(*) AS sources FROM s WHERE length(sentence) >= 20 GROUP BY sentence HAVING count(*) >= greatest(3, (SELECT count(DISTINCT source) FROM live) // 10)""",
        ),
        "ingestion_timeline": (
            lambda s, d: reports.ingestion_timeline(C(s, d)).select("tx_id", "chunks", F.array_join(F.transform(F.array_sort(F.map_entries("sources")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("sources"), F.unix_timestamp("first_recorded").alias("first_recorded")),
            f"{BASE} SELECT tx_id, CAST(sum(n) AS BIGINT) AS chunks, string_agg(source || '=' || n, ',' ORDER BY source) AS sources, CAST(epoch(min(t)) AS BIGINT) AS first_recorded FROM (SELECT tx_id, source, count(*) AS n, min(recorded_at) AS t FROM live GROUP BY ALL) GROUP BY tx_id",
        ),
        "staleness": (
            lambda s, d: reports.staleness(C(s, d), now(), 900),
            f"{BASE} SELECT revision_id, source, CAST(date_diff('day', vt_start, TIMESTAMP '{NOW}') AS INT) AS age_days FROM live WHERE date_diff('day', vt_start, TIMESTAMP '{NOW}') > 900",
        ),
        "staleness_by_source": (
            lambda s, d: reports.staleness_by_source(C(s, d), now(), 900),
            f"{BASE} SELECT source, count(*) AS stale, CAST(max(date_diff('day', vt_start, TIMESTAMP '{NOW}')) AS INT) AS oldest FROM live WHERE date_diff('day', vt_start, TIMESTAMP '{NOW}') > 900 GROUP BY source",
        ),
        "browse_source": (
            lambda s, d: reports.browse(C(s, d), None, 20, source="src1"),
            f"{BASE} SELECT revision_id, source, chunk_idx, CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '...' ELSE text END AS preview, (SELECT count(*) FROM live WHERE source = 'src1') AS total FROM live WHERE source = 'src1'",
        ),
        "insights": (
            lambda s, d: reports.insights(C(s, d), CL(s, d), now()).filter("priority < 3"),
            f"""{BASE}, st AS (SELECT source, count(*) AS n FROM live WHERE date_diff('day', vt_start, TIMESTAMP '{NOW}') > 365 GROUP BY source),
w AS (SELECT * FROM (SELECT 'short_chunks' AS action, '' AS subject, count(*) AS n FROM live WHERE length(text) < 50 UNION ALL SELECT 'low_confidence', '', count(*) FROM live WHERE confidence_bp < 3000
      UNION ALL SELECT 'source_imbalance', source, count(*) FROM live GROUP BY source HAVING count(*) > 0.5 * (SELECT count(*) FROM live) AND (SELECT count(DISTINCT source) FROM live) > 1) WHERE n > 0)
SELECT 0 AS priority, 'health' AS action, '' AS subject, greatest(0, 100 - 15 * (SELECT count(*) FROM w) - 3 * least((SELECT count(*) FROM st), 10)) AS count
UNION ALL SELECT 1, action, subject, n FROM w UNION ALL SELECT 2, 'refresh_source', source, n FROM st""",
        ),
        "entity_decisions": (
            decisions,
            """SELECT entity, decision, tx_id FROM (SELECT CAST(doc_id % 40 AS VARCHAR) AS entity, CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS decision, doc_id % 7 AS tx_id,
  row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id % 7 DESC, doc_id) AS n FROM labels WHERE doc_id IS NOT NULL) WHERE n = 1""",
        ),
        "annotations_by_tag": (
            lambda s, d: reports.search_by_tag(tb.annotated(s, d), " Toxic ").select("annotation_id", "revision_id", "source", F.array_join("tags", ",").alias("tags")),
            f"""{BASE} SELECT sha256('note:' || y.doc_id) AS annotation_id, live.revision_id, live.source, CASE WHEN quality = 1 THEN 'good,toxic' ELSE 'poor,toxic' END AS tags
FROM labels y JOIN live ON live.revision_id = sha256('chunk:' || y.doc_id || ':0') WHERE toxic = 1""",
        ),
        "delete_source": (
            lambda s, d: reports.delete_source(C(s, d), "src1", 99, F.lit(NOW).cast("timestamp")).select("core_id", "tx_id", "status", "evidence_ref"),
            f"{BASE} SELECT core_id, CAST(99 AS BIGINT) AS tx_id, 'retracted' AS status, 'source deleted' AS evidence_ref FROM ch WHERE source = 'src1'",
        ),
        "delete_cluster": (
            lambda s, d: reports.delete_cluster(C(s, d), CL(s, d), 7, 99, F.lit(NOW).cast("timestamp")).select("core_id", "status"),
            f"{BASE} SELECT core_id, 'retracted' AS status FROM ch JOIN cl USING (revision_id) WHERE cluster = 7",
        ),
        "regex_claims": (
            lambda s, d: extract.regex_claims(tb.load(s, d, "documents"), PATTERNS).select("doc_id", "claim_type", "evidence_ref", F.concat_ws("|", F.map_values("slots")).alias("slots")),
            " UNION ALL ".join(
                f"SELECT doc_id, '{kind}' AS claim_type, unnest(regexp_extract_all(text, '{rule}')) AS evidence_ref, lower({order} unnest(regexp_extract_all(text, '{rule}', {g1})) || '|' || unnest(regexp_extract_all(text, '{rule}', {g2}))) AS slots FROM documents"
                for kind, (rule, _), order, g1, g2 in (("email", PATTERNS["email"], "", 2, 1), ("number", PATTERNS["number"], "", 2, 1))
            ),
        ),
        "resolve_exact": (
            exact,
            """WITH a AS (SELECT lower(p_name) AS k, min(p_partkey) AS e FROM part GROUP BY ALL)
SELECT p_partkey, e AS entity_id, CASE WHEN e IS NOT NULL THEN 10000 END AS confidence_bp, CASE WHEN e IS NOT NULL THEN 'exact' END AS method
FROM part LEFT JOIN a ON a.k = lower(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END)""",
        ),
        "resolve_normalized": (
            subset,
            """WITH m AS (SELECT DISTINCT p_name || ' of ' || p_type AS mention FROM part UNION SELECT DISTINCT p_type FROM part), e AS (SELECT DISTINCT lower(p_type) AS name, p_type AS entity_id FROM part),
w AS (SELECT mention, list_distinct(string_split(lower(mention), ' ')) AS a FROM m), v AS (SELECT *, list_distinct(string_split(name, ' ')) AS b FROM e),
p AS (SELECT mention, arg_min(entity_id, name) AS part FROM w JOIN v ON list_has_all(a, b) OR list_has_all(b, a) GROUP BY mention)
SELECT mention, coalesce(e.entity_id, part) AS entity_id, CASE WHEN e.entity_id IS NOT NULL THEN 9500 WHEN part IS NOT NULL THEN 7000 END AS confidence_bp, CASE WHEN coalesce(e.entity_id, part) IS NOT NULL THEN 'normalized' END AS method
FROM m LEFT JOIN p USING (mention) LEFT JOIN e ON e.name = lower(mention)""",
        ),
        "question_kind": (
            asked,
            "SELECT n_nationkey, CASE n_nationkey % 8 WHEN 0 THEN 'factual' WHEN 1 THEN 'comparison' WHEN 2 THEN 'exploratory' WHEN 3 THEN 'multi-aspect' WHEN 4 THEN 'exploratory' WHEN 5 THEN 'exploratory' WHEN 6 THEN 'factual' ELSE 'exploratory' END AS kind FROM nation",
        ),
        "entity_links": (lambda s, d: graph.entity_links(graph.kept_lists(tb.lines(s, d), tb.line_clusters(s, d))), None),
        "review_entities": (lambda s, d: graph.review_entities(graph.kept_lists(tb.lines(s, d), tb.line_clusters(s, d)), tb.line_clusters(s, d), tb.lines(s, d)), None),
        "key_terms": (lambda s, d: evidence.key_terms(Q(s, d)), None),
        "answers": (lambda s, d: evidence.answers(evidence.answer_sentences(H(s, d, 10), HL(s, d, 10), Q(s, d))), None),
        "chunk_documents": (lambda s, d: extract.chunk_claims(tb.load(s, d, "documents").withColumn("source", F.col("doc_id").cast("string")), 1, now()).select("source", "slots", "assertion"), None),
    }
    return out
