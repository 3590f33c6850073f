"""Reports over the chunks of a store: each is an aggregation of the active rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import corpus
from .facts import Facts, assert_revisions, retract, tainted

SHORT, LONG, DOUBTFUL = 50, 2000, 3000
ANNOTATION, REVIEW = "internal.annotation@v1", "internal.entity_review@v1"


def list_sources(chunks: DataFrame) -> DataFrame:
    """source, chunks, first_page, last_page, pages, first_ingested of every source, bookkeeping under 'unknown'."""
    return corpus.active(chunks).groupBy("source").agg(
        F.count("*").alias("chunks"), F.min("page_start").alias("first_page"), F.max("page_start").alias("last_page"),
        F.countDistinct("page_start").alias("pages"), F.min("recorded_at").alias("first_ingested"),
    )


def source_detail(chunks: DataFrame, clusters: DataFrame, source: str | None = None) -> DataFrame:
    """Sizes, clusters and flags of one source, or of each: many_short (over 30 % under 100 characters), one_cluster."""
    d = corpus.documents(chunks)
    d = (d if source is None else d.filter(F.col("source") == source)).join(clusters, "revision_id", "left").withColumn("n", F.length("text"))
    g = d.groupBy("source").agg(
        F.count("*").alias("chunks"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("average"),
        F.countDistinct("cluster").alias("clusters"), F.count_if(F.col("n") < 100).alias("short"),
        F.min(F.col("page_start").cast("string")).alias("first_page"), F.max(F.col("page_start").cast("string")).alias("last_page"),
    )
    return g.withColumns({"many_short": F.col("short") > 0.3 * F.col("chunks"), "one_cluster": F.col("clusters") == 1})


def _measured(chunks: DataFrame) -> DataFrame:
    """`n`, the length, in place of the text: Spark would move whole texts through the joins to measure them behind."""
    return chunks.withColumn("n", F.length("text")).drop("text")


def quality_flags(chunks: DataFrame, clusters: DataFrame) -> DataFrame:
    """issue, subject, count: short and long chunks, orphans of the clusters, doubtful chunks, clusters of one source,
    sources with over half of all chunks."""
    d = corpus.documents(_measured(chunks)).join(clusters, "revision_id", "left")
    tests = {"short_chunks": F.col("n") < SHORT, "long_chunks": F.col("n") > LONG, "orphan_chunks": F.col("cluster").isNull(), "low_confidence": F.col("confidence_bp") < DOUBTFUL}
    named = F.filter(F.array(*[F.when(ok, F.lit(name)) for name, ok in tests.items()]), lambda x: x.isNotNull())
    rows = d.select(F.explode(named).alias("issue")).groupBy("issue").agg(F.lit("").alias("subject"), F.count("*").alias("count"))
    single = d.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.countDistinct("source").alias("s"), F.count("*").alias("count")).filter("s = 1")
    single = single.select(F.lit("single_source_cluster").alias("issue"), F.col("cluster").cast("string").alias("subject"), "count")
    share = d.groupBy("source").agg(F.count("*").alias("count")).crossJoin(F.broadcast(d.agg(F.count("*").alias("all"), F.countDistinct("source").alias("s"))))  # one row
    share = share.filter("s > 1 AND count > 0.5 * all").select(F.lit("source_imbalance").alias("issue"), F.col("source").alias("subject"), "count")
    return rows.unionByName(single).unionByName(share)


def quality_by_source(chunks: DataFrame, clusters: DataFrame) -> DataFrame:
    d = corpus.documents(_measured(chunks)).join(clusters, "revision_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("chunks"), F.round(F.avg("n"), 0).cast("long").alias("average"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.countDistinct("cluster").alias("clusters"))


def profile_sources(chunks: DataFrame, clusters: DataFrame, top: int | None = 20) -> DataFrame:
    """source, chunks, clusters, fraction of all active chunks."""
    d = corpus.active(chunks).join(clusters, "revision_id", "left")
    g = d.groupBy("source").agg(F.count("*").alias("chunks"), F.countDistinct("cluster").alias("clusters"))
    g = g.crossJoin(F.broadcast(g.agg(F.sum("chunks").alias("all")))).withColumn("fraction", F.round(F.col("chunks") / F.col("all"), 6)).drop("all")  # one row
    return g if top is None else g.orderBy(F.desc("chunks"), "source").limit(top)


def profile_clusters(chunks: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, size, sources, its three largest sources, its three first chunks, single_source, dominated (over 80 %)."""
    d = corpus.active(chunks).join(clusters, "revision_id")
    per = d.groupBy("cluster", "source").agg(F.count("*").alias("n"))
    order = Window.partitionBy("cluster").orderBy(F.desc("n"), "source")
    three = per.withColumn("r", F.row_number().over(order)).filter("r <= 3").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "source", "n"))).alias("l"))
    place = Window.partitionBy("cluster").orderBy("source", "chunk_idx", "revision_id")
    samples = d.withColumn("r", F.row_number().over(place)).filter("r <= 3").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "revision_id"))).alias("m"))
    total = per.groupBy("cluster").agg(F.sum("n").alias("size"), F.count("*").alias("sources"), F.max("n").alias("most"))
    out = total.join(three, "cluster").join(samples, "cluster")
    return out.select("cluster", "size", "sources", F.col("l.source").alias("top_sources"), F.col("m.revision_id").alias("samples"), (F.col("sources") == 1).alias("single_source"), (F.col("most") > 0.8 * F.col("size")).alias("dominated"))


def repeated_sentences(chunks: DataFrame, top: int | None = 20, least: int = 20) -> DataFrame:
    """Sentences of `least` characters and more that stand in at least max(3, a tenth of the sources) sources."""
    d = corpus.active(chunks)
    s = d.select("source", F.explode(F.array_distinct(F.transform(tx.sentences("text"), tx.normal_sentence))).alias("sentence")).filter(F.length("sentence") >= least)
    g = s.distinct().groupBy("sentence").agg(F.count("*").alias("sources"))
    bound = d.agg(F.greatest(F.lit(3), F.floor(F.countDistinct("source") / 10)).alias("bound"))
    g = g.crossJoin(F.broadcast(bound)).filter("sources >= bound").drop("bound")  # one row
    return g if top is None else g.orderBy(F.desc("sources"), "sentence").limit(top)


def ingestion_timeline(chunks: DataFrame) -> DataFrame:
    """tx_id, chunks, sources (source to count), first_recorded: what each transaction brought, bookkeeping left out."""
    d = corpus.active(chunks).filter(~F.col("claim_type").startswith(corpus.INTERNAL))
    per = d.groupBy("tx_id", "source").agg(F.count("*").alias("n"), F.min("recorded_at").alias("t"))
    g = per.groupBy("tx_id").agg(F.sum("n").alias("chunks"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("l"), F.min("t").alias("first_recorded"))
    return g.select("tx_id", "chunks", F.map_from_entries("l").alias("sources"), "first_recorded")


def staleness(chunks: DataFrame, now: Column, age_days: int = 365) -> DataFrame:
    """Chunks whose valid time began over `age_days` before `now`: revision_id, source, age_days."""
    age = F.datediff(now, F.col("vt_start"))
    return corpus.documents(chunks).select("revision_id", "source", age.alias("age_days")).filter(F.col("age_days") > age_days)


def staleness_by_source(chunks: DataFrame, now: Column, age_days: int = 365) -> DataFrame:
    return staleness(chunks, now, age_days).groupBy("source").agg(F.count("*").alias("stale"), F.max("age_days").alias("oldest"))


def browse(chunks: DataFrame, limit: int | None = 20, preview: int = 200, **equal: object) -> DataFrame:
    """Pages of active chunks, by source or cluster: the text's first characters, and the number of all rows that match."""
    d = corpus.active(chunks)
    for name, value in equal.items():
        d = d.filter(F.col(name) == value)
    short = F.when(F.length("text") > preview, F.concat(F.substring("text", 1, preview), F.lit("..."))).otherwise(F.col("text"))
    rows = d.select("revision_id", "source", "chunk_idx", short.alias("preview")).crossJoin(F.broadcast(d.agg(F.count("*").alias("total"))))  # one row
    return rows if limit is None else rows.orderBy("source", "chunk_idx", "revision_id").limit(limit)


def chunk_detail(chunks: DataFrame, clusters: DataFrame, edges: DataFrame, revision_id: str | None = None, k: int = 5) -> DataFrame:
    """A chunk with its cluster and its k nearest neighbours."""
    d = chunks if revision_id is None else chunks.filter(F.col("revision_id") == revision_id)
    near = edges.filter(F.col("rank") <= k).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "score"))).alias("neighbours"))
    return d.join(clusters, "revision_id", "left").join(near.withColumnRenamed("src", "revision_id"), "revision_id", "left")


def stats(facts: Facts) -> DataFrame:
    """name, n: rows of each table of a store."""
    out = None
    for name in ("cores", "revisions", "relations", "journal"):
        d = getattr(facts, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = d if out is None else out.unionByName(d)
    return out


def latest_decisions(decisions: DataFrame, key: str = "entity", value: str = "decision") -> DataFrame:
    """The decision with the largest transaction of each entity (ties: the smallest revision_id)."""
    best = F.min_by(F.col(value), F.struct(-F.col("tx_id"), "revision_id"))
    return decisions.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias(value), F.max("tx_id").alias("tx_id"))


def entity_decisions(facts: Facts) -> DataFrame:
    d = corpus.active(corpus.view(facts)).filter(F.col("claim_type") == REVIEW)
    return latest_decisions(d.select("revision_id", "tx_id", F.col("slots")["entity"].alias("entity"), F.col("slots")["decision"].alias("decision")))


def annotations(chunks: DataFrame, revision_id: str | None = None, tag: str | None = None) -> DataFrame:
    """annotation_id, target, tags, note of annotations whose target is still active."""
    live = corpus.active(chunks)
    tags = F.filter(F.transform(F.split(F.coalesce(F.col("slots")["tags"], F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    a = live.filter(F.col("claim_type") == ANNOTATION).select(F.col("revision_id").alias("annotation_id"), F.col("slots")["target"].alias("target"), tags.alias("tags"), F.col("text").alias("note"))
    a = a.join(live.select(F.col("revision_id").alias("target")), "target", "left_semi")
    a = a if revision_id is None else a.filter(F.col("target") == revision_id)
    return a if tag is None else a.filter(F.array_contains("tags", tag.strip().lower()))


def search_by_tag(chunks: DataFrame, tag: str) -> DataFrame:
    found = annotations(chunks, tag=tag).select("annotation_id", F.col("target").alias("revision_id"), "tags", "note")
    return found.join(chunks.select("revision_id", "source", "text"), "revision_id")


def claims(rows: DataFrame, claim_type: str | Column, slots: Column, assertion: Column, tx_id: int, now: Column, source: str, confidence_bp: int = 10000) -> DataFrame:
    """Rows for `facts.assert_revisions`: one claim a row, true from `now` on."""
    return rows.select(
        F.lit(claim_type).alias("claim_type"), slots.alias("slots"), assertion.alias("assertion"), now.alias("vt_start"), F.lit(None).cast("timestamp").alias("vt_end"), F.lit(tx_id).cast("long").alias("tx_id"),
        now.alias("recorded_at"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("evidence_ref"), F.lit(confidence_bp).alias("confidence_bp"), F.lit("asserted").alias("status"),
    )


def annotate(facts: Facts, target: str, tags: list[str], note: str, tx_id: int, now: Column) -> DataFrame:
    """The claim that annotates an active revision; an error if it is unknown or was retracted."""
    r = facts.revisions.filter(F.col("revision_id") == target)
    if r.filter("status = 'asserted'").join(tainted(facts.revisions), "core_id", "left_anti").isEmpty():
        raise ValueError(f"no active revision {target}")
    slots = F.create_map(F.lit("target"), F.lit(target), F.lit("tags"), F.lit(",".join(sorted({t.strip().lower() for t in tags if t.strip()}))))
    return claims(facts.revisions.sparkSession.range(1), ANNOTATION, slots, F.lit(note or "annotation"), tx_id, now, "user_annotation")


def decide(entities: DataFrame, decision: str, reason: str, tx_id: int, now: Column) -> DataFrame:
    """Claims that accept or reject entities (column entity)."""
    if decision not in ("accepted", "rejected"):
        raise ValueError("decision must be accepted or rejected")
    slots = F.create_map(F.lit("entity"), F.lower("entity"), F.lit("decision"), F.lit(decision))
    return claims(entities, REVIEW, slots, F.lit(reason), tx_id, now, "user_review")


def delete_source(chunks: DataFrame, source: str, tx_id: int, now: Column, reason: str = "source deleted") -> DataFrame:
    """Retraction rows for every asserted revision of a source, those of retracted cores too."""
    return _retractions(chunks.filter(F.col("source") == source), tx_id, now, reason)


def delete_cluster(chunks: DataFrame, clusters: DataFrame, cluster: int, tx_id: int, now: Column, reason: str = "cluster deleted") -> DataFrame:
    members = clusters.filter(F.col("cluster") == cluster).select("revision_id")
    return _retractions(chunks.join(members, "revision_id", "left_semi"), tx_id, now, reason)


def remove_annotation(chunks: DataFrame, annotation_id: str, tx_id: int, now: Column) -> DataFrame:
    return _retractions(chunks.filter((F.col("revision_id") == annotation_id) & (F.col("claim_type") == ANNOTATION)), tx_id, now, "annotation removed")


def _retractions(rows: DataFrame, tx_id: int, now: Column, reason: str) -> DataFrame:
    return retract(rows.withColumn("assertion", F.col("text")), tx_id, now, "user_review", reason)


def insights(chunks: DataFrame, clusters: DataFrame, now: Column) -> DataFrame:
    """priority, action, subject, count; and a row 'health': 100 less 15 a warning and 3 a stale source, of ten at most."""
    flags = quality_flags(chunks, clusters)
    warning = F.col("issue").isin("short_chunks", "low_confidence", "source_imbalance")
    todo = flags.select(F.when(warning, 1).otherwise(3).alias("priority"), F.col("issue").alias("action"), "subject", "count")
    stale = staleness_by_source(chunks, now).select(F.lit(2).alias("priority"), F.lit("refresh_source").alias("action"), F.col("source").alias("subject"), F.col("stale").alias("count"))
    all_ = todo.unionByName(stale)
    score = F.greatest(F.lit(0), 100 - 15 * F.count_if(F.col("priority") == 1) - 3 * F.least(F.count_if(F.col("action") == "refresh_source"), F.lit(10)))
    health = all_.agg(F.lit(0).alias("priority"), F.lit("health").alias("action"), F.lit("").alias("subject"), score.cast("long").alias("count"))
    return health.unionByName(all_)


def suggest_queries(labels: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """kind, query: questions about the two largest clusters (cluster, size, terms) and the smallest source."""
    top = labels.orderBy(F.desc("size"), "cluster").limit(2).withColumn("r", F.row_number().over(Window.orderBy(F.desc("size"), "cluster")))  # two rows
    explore = top.select(F.lit("exploratory").alias("kind"), F.concat_ws(" ", F.slice("terms", 1, 3)).alias("query"), (F.col("r") + 0).alias("o"))
    two = top.groupBy().agg(F.array_sort(F.collect_list(F.struct("r", "terms"))).alias("l")).filter(F.size("l") == 2)
    pair = [F.concat_ws(" ", F.slice(F.element_at("l", i)["terms"], 1, 2)) for i in (1, 2)]
    bridge = two.select(F.lit("reasoning").alias("kind"), F.concat(F.lit("In what way are "), pair[0], F.lit(" and "), pair[1], F.lit(" connected?")).alias("query"), F.lit(3).alias("o"))
    debate = top.filter("r = 1").select(F.lit("analytical").alias("kind"), F.concat(F.lit("On what do sources disagree about "), F.element_at("terms", 1), F.lit("?")).alias("query"), F.lit(4).alias("o"))
    least = list_sources(chunks).orderBy("chunks", F.desc("source")).limit(1)
    gap = least.select(F.lit("coverage").alias("kind"), F.concat(F.lit("Which topics does "), F.substring("source", 1, 40), F.lit(" treat?")).alias("query"), F.lit(5).alias("o"))
    return explore.unionByName(bridge).unionByName(debate).unionByName(gap).orderBy("o").limit(n).select("kind", "query")


def summarize(chunks: DataFrame, labels: DataFrame) -> str:
    """A few lines about a corpus, from its aggregates."""
    sources = list_sources(chunks).orderBy(F.desc("chunks"), "source")
    total = sources.agg(F.count("*").alias("s"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("c"), F.min("first_ingested").alias("t")).first()
    lines = [f"{total.c} chunks from {total.s} sources" + (f", since {total.t:%Y-%m-%d}" if total.t else "")]
    lines += [f"- {r.source}: {r.chunks}" for r in sources.limit(5).collect()]
    lines += [f"topic {r.cluster} ({r['size']}): {', '.join(r.terms)}" for r in labels.orderBy(F.desc("size"), "cluster").limit(5).collect()]
    return "\n".join(lines)


def render(rows: DataFrame, title: str, limit: int = 20) -> str:
    """A report as lines of text: a title, then `name: value` of each row."""
    names = rows.columns
    body = ["  ".join(f"{c}: {r[c]}" for c in names) for r in rows.limit(limit).collect()]
    return "\n".join([title, "=" * len(title), *(body or ["(nothing)"])])
