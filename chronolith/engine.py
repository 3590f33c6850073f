"""One object over a store: ingest, search, reports, graph, review, merge, saving."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import Auditor
from .operators import asof, corpus, evidence, extract, facts, graph, merge, reasoning, reports, search, state
from .operators.facts import Facts
from .sources import files
from .storage import written


class Engine:
    """A store with its index and graph.  Methods that answer return tables or small objects; those that change the
    store replace its tables, which are written so that lineage doesn't grow with the number of changes."""

    def __init__(self, spark: SparkSession, store: Facts | None = None, max_features: int | None = search.FEATURES) -> None:
        self.spark, self.max_features, self.audit = spark, max_features, Auditor()
        self._put(store or Facts.empty(spark))
        last = self.store.revisions.agg(F.max("tx_id").alias("t")).first().t  # one row
        self.tx = last or 0

    # -- the store -----------------------------------------------------------------------------------------------
    def _put(self, store: Facts) -> None:
        self.store = Facts(*(written(getattr(store, n), n) for n in ("cores", "revisions", "relations", "journal")))
        self.chunks = corpus.view(self.store)
        self._index: search.Index | None = None
        self.edges: DataFrame | None = None
        self.clusters: DataFrame | None = None

    def next_tx(self) -> int:
        self.tx += 1
        return self.tx

    def _assert(self, rows: DataFrame) -> int:
        before = self.store.revisions.count()
        self._put(facts.assert_revisions(self.store, rows))
        return self.store.revisions.count() - before

    def _append(self, rows: DataFrame) -> int:
        new = written(rows, "rows")
        self._put(replace(self.store, revisions=facts.append(self.store.revisions, new, "revision_id")))
        return new.count()

    @property
    def index(self) -> search.Index:
        """The index of all active rows, built when it is first needed after a change."""
        if self._index is None:
            ix = search.index(corpus.active(self.chunks), self.max_features)
            self._index = search.Index(written(ix.postings, "postings"), written(ix.vocabulary, "vocabulary"))
        return self._index

    def rebuild_index(self) -> int:
        self._index = None
        return self.index.postings.select("revision_id").distinct().count()

    # -- ingest --------------------------------------------------------------------------------------------------
    def ingest_texts(self, texts: DataFrame, **options: int) -> int:
        """Chunks texts (source, text, optionally vt_start) in one transaction; the number of new revisions."""
        return self._assert(extract.chunk_claims(texts, self.next_tx(), F.current_timestamp(), **options))

    def ingest_text(self, text: str, source: str = "text", **options: int) -> int:
        return self.ingest_texts(self.spark.createDataFrame([(source, text)], "source string, text string"), **options)

    def ingest_directory(self, folder: str, pattern: str | None = None, **options: int) -> DataFrame:
        """Chunks every readable file; the files that couldn't be read (path, error)."""
        found = written(files.read_folder(self.spark, folder, pattern), "files")
        good = found.filter("text IS NOT NULL").select("source", "text")
        claims = extract.chunk_claims(good, self.next_tx(), F.current_timestamp(), **options)
        self._assert(files.with_pages(claims, good.filter(F.contains("text", F.lit(files.PAGE)))))
        return found.filter("error IS NOT NULL").select("path", "error")

    def ingest_claims(self, claims: DataFrame, aliases: DataFrame | None = None, source: str = "extractor") -> int:
        """Claims (claim_type, slots, evidence_ref) as facts; slot values that are aliases (surface, entity_id) are resolved."""
        d = claims.withColumn("n", F.monotonically_increasing_id())
        if aliases is not None:
            d = written(d, "claims")
            slots = d.select("n", F.explode("slots").alias("slot", "mention"))
            known = extract.resolve_exact(slots, aliases).select("n", "slot", F.coalesce("entity_id", "mention").alias("value"))
            d = d.drop("slots").join(known.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("slots")), "n")
        return self._assert(reports.claims(d, F.col("claim_type"), F.col("slots"), F.col("evidence_ref"), self.next_tx(), F.current_timestamp(), source, 5000))

    # -- search --------------------------------------------------------------------------------------------------
    def _ranked(self, question: str, k: int, tx_id: int | None = None, valid_at: str | None = None) -> DataFrame:
        return search.temporal_search(self.index, self.chunks, search.one(self.chunks, question), k, tx_id, valid_at)

    def query(self, question: str, k: int = 5, tx_id: int | None = None, valid_at: str | None = None) -> list[reasoning.Hit]:
        with self.audit.record("query", question) as t:
            hits = self.retriever(tx_id, valid_at).query(question, k)[0] if question.strip() and k > 0 else []
            t.add("search", "top_k", {"k": k}, {"hits": len(hits)})
        return hits

    def retriever(self, tx_id: int | None = None, valid_at: str | None = None) -> reasoning.Retriever:
        return reasoning.Retriever(self.index, self.chunks, self.edges, self.clusters, tx_id, valid_at)

    def _found(self, name: str, f, question: str, **options: object) -> reasoning.Found:
        with self.audit.record(name, question) as t:
            out = f(self.retriever(), question, **options)
            for line in out.trace:
                t.add(name, line, outputs={"hits": len(out.hits)})
        return out

    def reason(self, question: str, **o: object) -> reasoning.Found:
        return self._found("reason", reasoning.reason, question, **o)

    def discover(self, seed: str, **o: object) -> reasoning.Found:
        return self._found("discover", reasoning.discover, seed, **o)

    def evidence_chain(self, claim: str, **o: object) -> reasoning.Found:
        return self._found("evidence_chain", reasoning.evidence_chain, claim, **o)

    def query_deep(self, question: str, **o: object) -> reasoning.Found:
        return self._found("query_deep", reasoning.query_deep, question, **o)

    def synthesize(self, question: str, **o: object) -> reasoning.Found:
        return self._found("synthesize", reasoning.synthesize, question, **o)

    def ask(self, question: str, **o: object) -> reasoning.Found:
        return self._found("ask", reasoning.ask, question, **o)

    def answer(self, question: str, **o: object) -> dict:
        return reasoning.answer(self.retriever(), question, **o)

    def query_multi(self, question: str, k: int = 10) -> DataFrame:
        return search.group_by_source(self._ranked(question, k), self.chunks)

    def query_with_context(self, question: str, k: int = 5, window: int = 1) -> DataFrame:
        return search.with_context(self._ranked(question, k), self.chunks, window)

    def query_by_source(self, source: str, k: int | None = 50, tx_id: int | None = None, valid_at: str | None = None) -> DataFrame:
        return search.by_source(self.chunks, source, k, tx_id, valid_at)

    def query_exact(self, tx_id: int, valid_at: str, core_id: str | None = None) -> DataFrame:
        return asof.query_as_of(self.store.revisions, tx_id, valid_at, core_id)

    def timeline(self, topic: str, k: int = 20) -> DataFrame:
        return search.timeline(self._ranked(topic, k), self.chunks)

    def timeline_diff(self, topic: str, tx_a: int, tx_b: int, k: int = 20) -> DataFrame:
        return search.timeline_diff(self.index, self.chunks, search.one(self.chunks, topic), tx_a, tx_b, k)

    def evolution(self, topic: str, k: int = 20) -> DataFrame:
        return search.evolution(self._ranked(topic, k), self.chunks)

    def coverage(self, topic: str, k: int = 20) -> DataFrame:
        return search.coverage(self._ranked(topic, k), self.chunks)

    def cite(self, question: str, k: int = 5, style: str = "inline") -> DataFrame:
        return search.cite_results(self._ranked(question, k), self.chunks, style)

    def explain(self, question: str, k: int = 5) -> DataFrame:
        return evidence.explain(self.index, self._ranked(question, k), search.one(self.chunks, question), self.chunks)

    def contradictions(self, topic: str, k: int = 20) -> DataFrame:
        return evidence.contradictions(self.index, self._ranked(topic, k), self.chunks).orderBy(F.desc("confidence_bp"), "a", "b")

    def confidence(self, claim: str, k: int = 10) -> dict:
        d = evidence.confidence(self._ranked(claim, k), self.chunks, search.one(self.chunks, claim), F.current_timestamp())
        return d.drop("qid").first().asDict()

    def deduplicate(self, least: float = 0.85) -> DataFrame:
        return graph.deduplicate(self.index, self.chunks, least)

    # -- graph ---------------------------------------------------------------------------------------------------
    def build_graph(self, least: float = 0.15, most: int = 10, clusters: int = 50) -> dict:
        self.clusters = written(graph.clusters(self.index, clusters), "clusters")
        self.edges = written(graph.edges(self.index, self.clusters, least, most), "edges")
        return graph.totals(self.edges, self.clusters).first().asDict()

    def _built(self) -> tuple[DataFrame, DataFrame]:
        if self.edges is None or self.clusters is None:
            raise ValueError("call build_graph first")
        return self.edges, self.clusters

    def topics(self) -> DataFrame:
        return graph.labels(self.index, self._built()[1])

    def topic_chunks(self, cluster: int, k: int = 10) -> DataFrame:
        return graph.topic_chunks(self._built()[1], self.chunks, cluster, k)

    def neighbors(self, revision_id: str, k: int = 5) -> DataFrame:
        return graph.neighbors(self._built()[0], self.chunks, k, revision_id)

    def path(self, start: str, end: str, max_depth: int = 4) -> list[str]:
        return graph.path(self._built()[0], start, end, max_depth)

    def entities(self) -> DataFrame:
        rejected = reports.entity_decisions(self.store).filter("decision = 'rejected'").select("entity")
        return graph.entities(self.chunks, self._built()[1], rejected)

    def link_entities(self, least: int = 2, most: int = 10) -> int:
        """Adds edges between chunks that share entities; how many are new."""
        old, _ = self._built()
        links = graph.entity_links(self.entities(), least, most)
        self.edges = written(graph.add_edges(old, links), "edges")
        return self.edges.count() - old.count()

    def review_entities(self, top: int = 50) -> DataFrame:
        return graph.review_entities(self.entities(), self._built()[1], self.chunks, top)

    # -- reports -------------------------------------------------------------------------------------------------
    def stats(self) -> dict:
        return {r.name: r.n for r in reports.stats(self.store).collect()}

    def list_sources(self) -> DataFrame:
        return reports.list_sources(self.chunks).orderBy(F.desc("chunks"), "source")

    def source_detail(self, source: str) -> DataFrame:
        return reports.source_detail(self.chunks, self._built()[1], source)

    def profile(self) -> dict[str, DataFrame]:
        c = self._built()[1]
        return {"sources": reports.profile_sources(self.chunks, c), "clusters": reports.profile_clusters(self.chunks, c), "repeated": reports.repeated_sentences(self.chunks)}

    def quality_report(self) -> DataFrame:
        return reports.quality_flags(self.chunks, self._built()[1])

    def ingestion_timeline(self) -> DataFrame:
        return reports.ingestion_timeline(self.chunks).orderBy("first_recorded")

    def staleness_report(self, age_days: int = 365) -> DataFrame:
        return reports.staleness_by_source(self.chunks, F.current_timestamp(), age_days)

    def scan_contradictions(self, k: int = 10) -> DataFrame:
        return evidence.scan_contradictions(self._built()[0], self.chunks, k=k)

    def compare_sources(self, a: str, b: str, least: float = 0.5) -> DataFrame:
        return evidence.compare_sources(self._built()[0], self.chunks, least).filter((F.col("source_a") == a) & (F.col("source_b") == b))

    def browse_source(self, source: str, limit: int = 20) -> DataFrame:
        return reports.browse(self.chunks, limit, source=source)

    def browse_cluster(self, cluster: int, limit: int = 20) -> DataFrame:
        return reports.browse(self.chunks.join(self._built()[1], "revision_id"), limit, cluster=cluster)

    def chunk_detail(self, revision_id: str) -> DataFrame:
        edges, clusters = self._built()
        return reports.chunk_detail(self.chunks, clusters, edges, revision_id)

    def insights(self) -> DataFrame:
        return reports.insights(self.chunks, self._built()[1], F.current_timestamp()).orderBy("priority", "action", "subject")

    def suggest_queries(self, n: int = 5) -> DataFrame:
        return reports.suggest_queries(self.topics(), self.chunks, n)

    def summarize_corpus(self) -> str:
        return reports.summarize(self.chunks, self.topics())

    # -- review --------------------------------------------------------------------------------------------------
    def annotate_chunk(self, revision_id: str, tags: list[str] | None = None, note: str = "") -> int:
        return self._keep_graph(lambda: self._assert(reports.annotate(self.store, revision_id, tags or [], note, self.next_tx(), F.current_timestamp())))

    def list_annotations(self, revision_id: str | None = None, tag: str | None = None) -> DataFrame:
        return reports.annotations(self.chunks, revision_id, tag)

    def search_by_tag(self, tag: str) -> DataFrame:
        return reports.search_by_tag(self.chunks, tag)

    def remove_annotation(self, annotation_id: str) -> int:
        return self._keep_graph(lambda: self._append(reports.remove_annotation(self.chunks, annotation_id, self.next_tx(), F.current_timestamp())))

    def decide_entities(self, names: list[str], decision: str, reason: str = "reviewed") -> int:
        rows = self.spark.createDataFrame([(n,) for n in names], "entity string")
        return self._keep_graph(lambda: self._assert(reports.decide(rows, decision, reason, self.next_tx(), F.current_timestamp())))

    def entity_decisions(self) -> DataFrame:
        return reports.entity_decisions(self.store)

    def delete_source(self, source: str, reason: str = "source deleted") -> int:
        return self._append(reports.delete_source(self.chunks, source, self.next_tx(), F.current_timestamp(), reason))

    def delete_cluster(self, cluster: int, reason: str = "cluster deleted") -> int:
        """Retracts the members of a cluster; the graph stays, without them."""
        edges, clusters = self._built()
        gone = written(clusters.filter(F.col("cluster") == cluster).select("revision_id"), "gone")
        n = self._append(reports.delete_cluster(self.chunks, clusters, cluster, self.next_tx(), F.current_timestamp(), reason))
        self.edges, self.clusters = written(graph.without(edges, gone), "edges"), written(clusters.join(gone, "revision_id", "left_anti"), "clusters")
        return n

    def _keep_graph(self, change) -> int:
        edges, clusters = self.edges, self.clusters
        n = change()
        self.edges, self.clusters = edges, clusters
        return n

    # -- merge and saving ----------------------------------------------------------------------------------------
    def merge(self, other: Facts, record_as: int | None = None) -> DataFrame:
        """Merges another store; its conflicts.  With `record_as` they go to the journal under this transaction."""
        if record_as is None:
            new, conflicts = merge.merge(self.store, other)
        else:
            new, conflicts = merge.merge_and_record(self.store, other, asof.with_bucket(other.relations, other.revisions), record_as)
        conflicts = written(conflicts, "conflicts")
        self._put(new)
        self.tx = max(self.tx, self.store.revisions.agg(F.max("tx_id").alias("t")).first().t or 0)
        return conflicts

    def save(self, folder: str) -> None:
        """The store, and the index and graph if they are built, as Parquet."""
        state.save(self.store, folder, tx=self.tx)
        parts = {"postings": self._index and self._index.postings, "vocabulary": self._index and self._index.vocabulary, "edges": self.edges, "clusters": self.clusters}
        for name, d in parts.items():
            if d is not None:
                d.write.mode("overwrite").parquet(f"{folder}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Engine:
        """A saved engine.  Only parts that were saved with it are read; nothing but tables is loaded."""
        out = cls(spark, state.load(spark, folder))
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        have = {f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}
        if {"postings", "vocabulary"} <= have:
            out._index = search.Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/vocabulary"))
        for name in ("edges", "clusters"):
            if name in have:
                setattr(out, name, spark.read.parquet(f"{folder}/{name}"))
        return out
