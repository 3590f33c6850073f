"""The engine from ingest to saving; files, streams, tools, command line; snapshots and journal."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from chronolith import cli, tables
from chronolith.engine import Engine
from chronolith.operators import asof, facts, merge, state
from chronolith.operators.facts import Facts
from chronolith.sources import files
from chronolith.storage import written
from chronolith.streaming import folds
from chronolith.tools import TOOLS, Tools

TEXTS = {
    "cells": "Cells are the basic units of life. Mitochondria produce energy for cells.\n\nPlant cells have walls and chloroplasts.",
    "energy": "Solar panels turn light into energy. Wind turbines produce energy when wind blows.",
    "doubt": "Mitochondria never produce energy for cells. Wind turbines do not produce energy at night.",
    "ships": "Sailing ships crossed oceans with wind. Steam engines replaced sails in 1850.",
}


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    rows = [(s, (t + "\n\n") * 3 + f"Closing words about {s} and what it means.") for s, t in TEXTS.items()]
    assert e.ingest_texts(spark.createDataFrame(rows, "source string, text string"), size=120, overlap=20) > 8
    e.build_graph(clusters=3)
    return e


def test_queries(engine):
    hits = engine.query("mitochondria energy cells", k=3)
    assert hits and hits[0].source in ("cells", "doubt") and "itochondria" in hits[0].text.capitalize() or "mitochondria" in hits[0].text
    assert engine.query("  ") == [] and engine.query("mitochondria", k=0) == [] and engine.query("zzz unknown") == []
    assert engine.query("mitochondria", tx_id=0, valid_at="2000-01-01") == []
    assert engine.query_by_source("SHIPS").count() == engine.list_sources().filter("source = 'ships'").first().chunks
    assert {r.source for r in engine.query_multi("wind energy", 10).collect()} >= {"energy", "doubt"}
    assert engine.timeline("wind").count() and engine.evolution("wind").count() and engine.coverage("wind").count()
    assert engine.cite("wind", style="full").first().citation.startswith("Source: ")
    assert engine.confidence("mitochondria produce energy")["evidence"] > 1
    assert engine.contradictions("mitochondria produce energy for cells").filter("confidence_bp >= 2000").count() > 0
    assert engine.explain("wind turbines").count() == 5 and engine.timeline_diff("wind", 0, 9).filter("side = 'b'").count() > 0


def test_steps(engine):
    for f in (engine.reason, engine.discover, engine.evidence_chain, engine.query_deep, engine.synthesize, engine.ask):
        found = f("wind turbines and mitochondria energy")
        ids = [h.revision_id for h in found.hits]
        assert ids and len(set(ids)) == len(ids), f
        assert found.summary() and found.context_for_model(2).startswith("[1]")
    assert "energy" in engine.synthesize("energy from wind").context
    for kind in ("factual", "comparison", "exploratory"):
        assert engine.ask("wind turbines", strategy=kind).trace[0] == f"strategy: {kind}"
    with pytest.raises(ValueError):
        engine.ask("x", strategy="odd")
    got = engine.answer("What produces energy for cells?")
    assert got["sentences"] and 0 < got["confidence"] <= 1 and engine.answer("zzz")["sentences"] == []
    engine.audit.enabled = True
    engine.query("wind")
    assert engine.audit.last.operation == "query" and "wind" in engine.audit.last.render() and json.loads(engine.audit.last.to_json())["events"]


def test_graph_and_reports(engine):
    assert engine.topics().agg(F.sum("size").alias("s")).first().s == engine.clusters.count()
    one = engine.edges.first()
    assert engine.neighbors(one.src).count() > 0 and engine.path(one.src, one.dst) == [one.src, one.dst]
    assert engine.chunk_detail(one.src).first().neighbours and engine.topic_chunks(0).count() > 0
    assert engine.quality_report().count() >= 0 and engine.insights().filter("action = 'health'").count() == 1
    assert engine.source_detail("ships").first().chunks > 0 and engine.browse_source("ships", 1).count() == 1
    assert engine.suggest_queries().count() == 5 and "4 sources" in engine.summarize_corpus()
    assert engine.ingestion_timeline().first().chunks == engine.stats()["revisions"] and engine.staleness_report().count() == 0
    assert set(engine.profile()) == {"sources", "clusters", "repeated"} and engine.deduplicate().count() > 0
    assert engine.link_entities(least=1) >= 0 and engine.review_entities().columns[0] == "entity"
    with pytest.raises(ValueError):
        Engine(engine.spark).topics()


def test_review_delete_save_merge(spark, engine, tmp_path):
    engine.save(str(tmp_path / "store"))
    e = Engine.load(spark, str(tmp_path / "store"))
    assert e.stats() == engine.stats() and e.tx == engine.tx and [h.revision_id for h in e.query("wind")] == [h.revision_id for h in engine.query("wind")]
    target = e.query("sailing ships")[0].revision_id
    assert e.annotate_chunk(target, ["Old ", "sea"], "see map") == 1 and e.edges is not None
    note = e.list_annotations(tag="OLD").first()
    assert note.target == target and note.tags == ["old", "sea"] and e.search_by_tag("sea").first().source == "ships"
    with pytest.raises(ValueError):
        e.annotate_chunk("nothing", ["x"])
    assert e.remove_annotation(note.annotation_id) == 1 and e.list_annotations().count() == 0
    e.decide_entities(["wind"], "accepted")
    e.decide_entities(["wind", "steam"], "rejected")
    assert {r.entity: r.decision for r in e.entity_decisions().collect()} == {"wind": "rejected", "steam": "rejected"}
    n = e.list_sources().filter("source = 'ships'").first().chunks
    assert e.delete_source("ships") == n and e.list_sources().filter("source = 'ships'").isEmpty() and all(h.source != "ships" for h in e.query("sailing ships"))
    assert e.delete_source("ships") == n  # those of retracted cores too
    with pytest.raises(ValueError):
        e.neighbors(target)
    e.build_graph(clusters=2)
    assert e.delete_cluster(0) > 0 and e.clusters.filter("cluster = 0").isEmpty()
    conflicts = e.merge(engine.store)
    assert conflicts.columns == ["code", "entity_id", "details"] and e.stats()["revisions"] >= engine.stats()["revisions"]
    got = e.ingest_claims(spark.createDataFrame([("birth", {"who": "Big Blue"}, "text")], "claim_type string, slots map<string,string>, evidence_ref string"), spark.createDataFrame([("big blue", "ibm")], "surface string, entity_id string"))
    assert got == 1 and e.store.cores.filter("slots['who'] = 'ibm'").count() == 1


def _office(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_files(spark, tmp_path):
    w, a = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("Plain text about harbours.")
    (folder / "README").write_text("No suffix here, but text.")
    (folder / "b.md").write_bytes(b"\xff\xfe broken")
    (folder / "blank.txt").write_text("  \n")
    (folder / "image.png").write_bytes(b"png")
    (folder / "bad.docx").write_bytes(b"no zip")
    p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
    row = "<w:tbl><w:tr>" + "".join(f"<w:tc>{p.format(x)}</w:tc>" for x in ("left", "right")) + "</w:tr></w:tbl>"
    _office(folder / "c.docx", {"word/document.xml": f"<w:document {w}><w:body>{p.format('First')}{p.format(' ')}{row}{p.format('Last')}</w:body></w:document>"})
    slide = "<p {a}><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p>"
    _office(folder / "d.pptx", {"ppt/slides/slide10.xml": slide.format(a=a, t="Tenth slide of this deck"), "ppt/slides/slide2.xml": slide.format(a=a, t="Second slide of this deck"), "ppt/notesSlides/notesSlide2.xml": slide.format(a=a, t="say hello")})
    got = {r.source: r for r in files.read_folder(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {"a.txt", "README", "b.md", "blank.txt", "bad.docx", "c.docx", "d.pptx"}
    assert got["b.md"].error and got["bad.docx"].error and got["blank.txt"].text is None and got["blank.txt"].error is None
    assert got["c.docx"].text == "First\n\nleft | right\n\nLast" and got["d.pptx"].text == "Second slide of this deck\n\n[Notes] say hello\n\f\nTenth slide of this deck"
    e = Engine(spark)
    assert {r.path.rsplit("/", 1)[1] for r in e.ingest_directory(str(tmp_path / "in"), size=30, overlap=0).collect()} == {"b.md", "bad.docx"}
    pages = {r.text: r.page_start for r in e.chunks.filter("source = 'd.pptx'").collect()}
    assert any("tenth" in t and n == 2 for t, n in pages.items()) and any("second" in t and n == 1 for t, n in pages.items())
    d = spark.createDataFrame([("one two\n\n\n\n\nthree hy-\nphen\n 12 \nend  of\nline",)], "t string").select(files.clean_pdf("t").alias("t"))
    assert d.first().t == "one two\n\n\nthree hyphen\n\nend of line"


def test_tools_and_command_line(spark, engine, tmp_path, capsys):
    t = Tools(engine)
    assert {x["name"] for x in t.list_tools()} == set(TOOLS) and len(TOOLS) >= 25 and all(hasattr(Engine, v[3]) for v in TOOLS.values())
    assert t.call("query", {"question": "wind", "k": 2})["result"][0]["score"] > 0
    assert t.call("list_sources")["result"][0]["source"] and t.call("stats")["result"]["cores"] > 0
    assert "error" in t.call("nothing") and "error" in t.call("query") and "error" in t.call("query", {"question": 5}) and "error" in t.call("query", {"question": "x", "odd": 1}) and "error" in t.call("ask", {"question": "x", "strategy": "odd"})
    (tmp_path / "in").mkdir()
    for s, x in TEXTS.items():
        (tmp_path / "in" / f"{s}.txt").write_text(x)
    store = str(tmp_path / "made")

    def run(*argv, lines=()):
        args = cli.parser().parse_args([store, *argv])
        return list(cli.run(Engine.load(spark, store) if (tmp_path / "made").exists() else Engine(spark), args, lines))

    assert "store:" in run("ingest", str(tmp_path / "in"))[-1]
    assert "ships" in run("query", "steam engines", "-k", "1")[0] and "hop 0" in run("query", "steam engines", "--reason")[0]
    assert json.loads(run("stats")[0])["revisions"] == 4 and len(run("sources")) == 4
    out = [json.loads(x) for x in run("serve", lines=['{"name": "list_tools"}', "junk", '{"name": "stats"}'])]
    assert len(out[0]["result"]) == len(TOOLS) and "error" in out[1] and out[2]["result"]["cores"] == 4
    assert run("repl", lines=["steam engines", "", "wind"]) and json.loads(run("call", "stats")[0])["result"]["cores"] == 4
    run("save", str(tmp_path / "copy"))
    assert Engine.load(spark, str(tmp_path / "copy")).stats()["cores"] == 4


def test_streams_equal_batches(spark, tmp_path):
    rows = [("c1", "e", "d"), ("c1", "e", "d"), ("c2", "f", "d"), (None, None, None), ("c1", "g", "x")]
    d = spark.createDataFrame(rows, folds.CONFLICT)
    for i, part in enumerate((d.limit(2), d.exceptAll(d.limit(2)))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for name, fold, batch in (("s", folds.signature_counts, merge.signature_counts), ("c", folds.code_counts, merge.code_counts), ("m", folds.summary, merge.summary)):
        q = fold(folds.conflicts(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName(f"fold_{name}").option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = spark.table(f"fold_{name}")
        want = batch(d).select(*got.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    merge.summary(d).write.parquet(str(tmp_path / "sums"))
    q = folds.add_counts(folds.conflicts(spark, str(tmp_path / "sums"), folds.SUMMARY)).writeStream.outputMode("complete").format("memory").queryName("fold_sum").option("checkpointLocation", str(tmp_path / "cp_sum")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("fold_sum").exceptAll(merge.summary(d).select(*spark.table("fold_sum").columns)).isEmpty()
    spark.createDataFrame([("a", "Streamed text about tides and moons.")], "source string, text string").write.parquet(str(tmp_path / "texts"))
    kept = []
    stream = spark.readStream.schema("source string, text string").parquet(str(tmp_path / "texts"))
    folds.ingest(stream, Facts.empty(spark), F.lit("2024-01-01").cast("timestamp"), lambda f, tx: kept.append((tx, f.revisions.count())), str(tmp_path / "cp")).awaitTermination(120)
    assert kept == [(1, 1)]


def _store(spark):
    rows = spark.createDataFrame([("fact", {"Id": "Één"}, "first", "2024-01-01", None, 1, "asserted"), ("fact", {"id": "two"}, "second", "2024-01-01", "2025-01-01", 2, "asserted")],
                                 "claim_type string, slots map<string,string>, assertion string, vt_start string, vt_end string, tx_id long, status string")
    rows = rows.withColumns({"recorded_at": F.lit("2024-01-02 03:04:05").cast("timestamp"), "source": F.lit("test"), "evidence_ref": F.lit(None).cast("string"), "confidence_bp": F.lit(9000), "vt_end": F.col("vt_end").cast("timestamp")})
    f = facts.assert_revisions(Facts.empty(spark), rows)
    a, b = sorted(r.revision_id for r in f.revisions.collect())
    edges = spark.createDataFrame([("supports", a, b, 2), ("contradicts", b, a, 2), ("supports", a, "missing", 2)], "relation_type string, from_revision_id string, to_revision_id string, tx_id long")
    f, rejected = facts.attach_relations(f, edges.withColumn("recorded_at", F.lit("2024-01-02").cast("timestamp")))
    assert rejected.count() == 1 and f.relations.filter(f"relation_type = 'contradicts' AND from_revision_id = '{a}'").count() == 1
    return Facts(*(written(getattr(f, n), n) for n in ("cores", "revisions", "relations", "journal"))), edges


def test_snapshots_and_validation(spark, tmp_path):
    f, _ = _store(spark)
    state.validate(f)
    state.write_json(f, str(tmp_path / "s.json"))
    back = state.read_json(spark, str(tmp_path / "s.json"))
    assert state.canonical_payload(back) == state.canonical_payload(f)
    pending = spark.createDataFrame([("supports", f.revisions.first().revision_id, "missing", 1)], "relation_type string, from_revision_id string, to_revision_id string, tx_id long")
    waiting = Facts(f.cores, f.revisions, f.relations.unionByName(facts.relations(pending.withColumn("recorded_at", F.lit("2024-01-02").cast("timestamp")))), f.journal)
    state.validate(waiting)  # a pending edge is lawful
    state.write_json(waiting, str(tmp_path / "w.json"))
    assert state.read_json(spark, str(tmp_path / "w.json")).relations.count() == 3
    text = (tmp_path / "s.json").read_text()
    for bad in (text.replace("first", "frist"), text + " ", text.replace('"schema_version":1', '"schema_version":2'), text.replace('"cores"', '"kores"'), "{"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            state.read_json(spark, str(tmp_path / "bad.json"))
    with pytest.raises(ValueError):
        state.validate(Facts(f.cores, f.revisions.withColumn("confidence_bp", F.lit(1)), f.relations, f.journal))
    state.save(f, str(tmp_path / "p"))
    assert state.load(spark, str(tmp_path / "p")).revisions.exceptAll(f.revisions).isEmpty()


def test_journal_and_transitions(spark):
    f, _ = _store(spark)
    other = Facts(f.cores, f.revisions.withColumn("confidence_bp", F.lit(1)).filter("tx_id = 2"), f.relations.limit(0), f.journal)
    bucketed = asof.with_bucket(other.relations, other.revisions)
    merged, conflicts = merge.merge_and_record(f, other, bucketed)
    assert [r.code for r in conflicts.collect()] == ["revision_id_collision"] and [(r.tx_id, r.seq, r.code) for r in merged.journal.collect()] == [(2, 0, "revision_id_collision")]
    again, _ = merge.merge_and_record(merged, Facts(f.cores, f.revisions.filter("tx_id = 2"), f.relations.limit(0), f.journal), bucketed)
    assert [(r.seq, r.code) for r in again.journal.orderBy("seq").collect()] == [(0, "revision_id_collision"), (1, None)]
    assert merge.conflicts_as_of(again.journal, 2).filter("kind = 'code'").first()["count"] == 1
    with pytest.raises(ValueError):
        merge.derive_journal_tx(bucketed, f.revisions)
    many = spark.range(500).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("code"), F.col("id").cast("string").alias("entity_id"), F.lit("d").alias("details"))
    seqs = [r.seq for r in merge.record(merged.journal, many, 7).orderBy("seq").collect()]
    assert seqs == list(range(501))
    b = asof.with_bucket(f.relations, f.revisions)
    moved = state.fingerprint_transition(f.revisions, b, 1, 2, "2024-06-01").collect()
    assert {(r.change, r["list"]) for r in moved} == {("entered", "revision_active"), ("entered", "resolution_active"), ("entered", "lifecycle_active")}
    assert state.fingerprint(f.revisions, b, None, 2, "2024-06-01", tx_start=2).first().ordered_projection.count('"') > 0


def test_relations_follow_the_next_event(spark):
    """Hours without events, ties of time: as one window over all events."""
    d = tables.load(spark, "/root/testdata/sf0.001", "events").select("event_id", "ts")
    rows = sorted((r.ts, r.event_id) for r in d.collect())
    want = {a: b for (_, a), (_, b) in zip(rows, rows[1:])}
    got = {r.event_id: (r.from_revision_id, r.to_revision_id) for r in tables.relations(spark, "/root/testdata/sf0.001").collect()}
    ids = {r.event_id: r.h for r in d.select("event_id", F.sha2(F.concat(F.lit("event:"), F.col("event_id").cast("string")), 256).alias("h")).collect()}
    assert set(got) == set(want) and all(set(got[a]) == {ids[a], ids[b]} for a, b in want.items() if a % 20)
