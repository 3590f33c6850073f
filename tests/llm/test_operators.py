"""The ten operators: SQL where there is one, brute force, and odd tables."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import chat, fingerprint, license, minhash, mixing, packing, pii, queries, topk, toxicity, urlfilter

DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, Tokens string, bucket int, sig string, gone long"
LONG = "lorem ipsum dolor " * 60000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, None, "x", 1, None, None) for i, t, s in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns."""
    text = "The quick brown fox jumps over the lazy dog and runs far away from here today."
    rows = [(1, text, "a"), (1, text, "a"), (2, text + " Ok.", None), (3, None, "b"), (4, "", "b"), (None, text, "a"), (5, LONG, "c"), (6, " \n ", None), (None, None, None)]
    return docs(spark, rows).coalesce(2)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(agree, name):
    agree(queries.queries()[name], queries.oracle_sql()[name])


def test_chat(spark):
    t = spark.createDataFrame([("c", 2, "user", "b"), ("c", 1, "user", "a"), ("c", 3, None, None), (None, 1, "user", "x"), ("c", 1, "user", "a")], "conv_id string, turn int, role string, text string")
    assert [tuple(r) for r in chat.format_chats(t).collect()] == [("c", 3, 2, "<|user|>\na\nb<|end|>\n<|unknown|>\n<|end|>")]
    assert chat.format_chats(t.limit(0)).count() == 0


def test_pack(odd, none):
    got = packing.pack(odd).collect()
    assert all(len(r.text.split()) == r.n_tokens == 2**r.bucket for r in got)
    assert " ".join(r.text for r in sorted((r for r in got if r.doc_id == 5), key=lambda r: r.start)) == LONG.strip()
    assert {r.doc_id for r in got} == {1, 2, 5, None} and packing.pack(none).count() == 0


def test_mix_keeps_every_token_and_the_weights(odd, none):
    got = mixing.mix(odd, block=1024).collect()
    seen = {(r.doc_id, r.source, r.start, r.n_tokens) for r in got}
    assert sum(n for d, _, _, n in seen if d == 5) == 180000
    assert {d for d, *_ in seen} == {1, 2, 5, None} and mixing.mix(none).count() == 0


def test_near_duplicates_against_exact_resemblance(spark, none, odd):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[vocabulary[i] for i in rng.integers(0, 400, 120)] for _ in range(25)]
    rows, texts = [], {}
    for k, words in enumerate(base):
        for c in range(3 if k % 2 else 1):
            w = list(words)
            if c:
                w[int(rng.integers(0, 120))] = f"new{k}{c}"
            texts[100 * k + c] = " ".join(w)
    rows = [(i, t, "s") for i, t in texts.items()]
    got = {(r.doc_id, r.kept_id) for r in minhash.near_duplicates(docs(spark, rows)).collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    s = {i: shingles(t) for i, t in texts.items()}
    want = {(b, a - a % 100) for a in s for b in s if a < b and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.75}
    assert got == want
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_near_duplicates(none).count() == 0
    left = Counter(r.doc_id for r in minhash.drop_near_duplicates(odd).collect())
    assert left[1] == 1 and left[None] == 2 and left[3] == left[4] == left[5] == left[6] == 1


def test_topk_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (None, [1.0, 1.0]), (6, [float("nan"), 2.0]), (6, [float("nan"), 2.0]), (7, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.topk(v, k=2).collect()]
    want = []
    m = {1: (1, 0), 2: (1, 0), 3: (0, 1), 4: (0, 0), 6: (0, 1)}
    for q, a in m.items():
        best = sorted((-(a[0] * b[0] + a[1] * b[1]), c) for c, b in m.items() if c != q)[:2]
        want += [(q, i + 1, c, float(-s)) for i, (s, c) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert topk.topk(v.limit(0)).count() == 0


def test_url_filter(spark):
    c = spark.createDataFrame([(1, "http://a.ex.org/p/q", "2024-02-01"), (2, None, "2024-02-01"), (3, "http://ex.org/", None), (4, "http://ex.org/", "2024-01-01"), (5, "http://ex.org/", "2024-03-01")], "page_id long, url string, fetched_at string")
    e = spark.createDataFrame([("ex.org", "block", "2024-01-01"), ("ex.org", "clear", "2024-03-01"), ("a.ex.org/p", "allow", "2024-01-15"), (None, "block", "2024-01-01")], "pattern string, action string, listed_at string")
    assert {r.page_id: r.verdict for r in urlfilter.url_filter(c, e).collect()} == {1: "allow", 2: "none", 3: "none", 4: "block", 5: "none"}
    assert {r.verdict for r in urlfilter.url_filter(c, e.limit(0)).collect()} == {"none"} and urlfilter.url_filter(c.limit(0), e).count() == 0


def test_fingerprints(spark, odd, none):
    rng = np.random.default_rng(2)
    text = "".join(chr(c) for c in rng.integers(97, 123, 6000))
    other = "".join(chr(c) for c in rng.integers(97, 123, 6000))
    rows = [(1, text, "s"), (2, text[:5500] + "changed", "s"), (3, other, "s"), (4, "short", "s"), (5, "short", "s"), (6, "a" * 500, "s")]
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs(spark, rows)).collect()}
    assert got[2].match_id == 1 and got[1].match_id == 2 and got[2].match_score > 60 and got[3].match_id is None
    assert got[5].class_id == 4 and got[5].n_copies == 2 and got[6].n_features == 0 and got[6].class_id == 6
    raw = np.frombuffer(text[:500].encode(), np.uint8)
    for i, s in enumerate(fingerprint.entropy_scores(raw)):
        p = np.bincount(raw[i : i + 64]) / 64
        p = p[p > 0]
        assert abs(s - 1000 * -(p * np.log2(p)).sum() / 6) <= 1.01
    assert fingerprint.fingerprints(none).count() == 0 and Counter(r.doc_id for r in fingerprint.fingerprints(odd).collect())[1] == 2


def test_selection_by_plain_votes_and_in_stretches(monkeypatch):
    rng = np.random.default_rng(6)
    raw = np.concatenate([rng.integers(97, 97 + k, 900) for k in (26, 3, 12, 1, 20)]).astype(np.uint8)
    rank = rng.permutation(1001).astype(np.int64)
    rank[:100] = fingerprint._NONE
    key = rank[fingerprint.entropy_scores(raw)]
    votes = Counter()
    for a in range(len(key) - 63):
        k = min(range(a, a + 64), key=lambda i: (key[i], i))
        votes[k] += key[k] < fingerprint._NONE
    want = sorted(k for k, n in votes.items() if n >= 16)
    off = np.array([0, 0, len(raw)])
    assert fingerprint.select(raw, off, rank)[1].tolist() == want and len(want) > 20
    monkeypatch.setattr(fingerprint, "STRETCH", 500)
    doc, at = fingerprint.selected(raw, off, rank)
    assert at.tolist() == want and set(doc.tolist()) == {1}


def test_fingerprints_against_all_pairs(spark):
    """A later copy whose features all occurred in earlier, different documents; a passage many share; copies; blocks."""
    rng = np.random.default_rng(5)

    def noise(n):
        return "".join(chr(c) for c in rng.integers(97, 123, n))

    a, b, passage = noise(4000), noise(4000), noise(700)
    long = noise(60000)
    rows = [(1, a + noise(9000)), (2, b + noise(9000)), (3, a + b), (4, a + b), (5, a + b + noise(40)), (6, long), (7, long[:50000] + noise(9000)), (7, b), (8, "short")]
    rows += [(10 + i, noise(300) + passage + noise(40 * i)) for i in range(40)]
    d = docs(spark, [(i, t, "s") for i, t in rows])
    rank, blobs = fingerprint.rarity(d), []
    for i, t in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        f = fingerprint.feature_hashes(raw, fingerprint.select(raw, np.array([0, len(raw)]), rank)[1]) if len(raw) >= 64 else fingerprint.short_feature(raw)
        f = list(dict.fromkeys(f.view(np.int64).tolist()))
        blobs.append((i, f, fingerprint.bloom(np.array(f, np.int64).view(np.uint64))))
    kinds = {}
    for i, f, x in blobs:
        kinds.setdefault((len(f), x), [f, []])[1].append(i)
    df = Counter(f for f, _ in kinds.values() for f in f)
    tells = {k: set(sorted((x for x in f if df[x] > 1), key=lambda x: (df[x], x), reverse=True)[len(f) // 4 :]) | {x for x in f if df[x] == 1} for k, (f, _) in kinds.items()}
    linked, lost = {k: [] for k in kinds}, 0
    for p, (f, _) in kinds.items():
        for q, (g, ids) in kinds.items():
            both = set(f) & set(g)
            if p != q and both:
                s = max(fingerprint.compare(p[1], p[0], q[1], q[0]), fingerprint.compare(q[1], q[0], p[1], p[0]))
                if s >= fingerprint.MATCH:
                    if both & (tells[p] | tells[q]):
                        linked[p].append((-s, min(ids)))
                    else:
                        lost += 1
    assert lost == 0 and sum(map(len, linked.values())) > 60
    want = []
    for i, f, x in blobs:
        k, ids = (len(f), x), kinds[len(f), x][1]
        s, m = min(linked[k], default=(None, None))
        want.append((i, len(f), min(ids), len(ids), len(linked[k]), m, s and -s))
    for block in (fingerprint.BLOCK, 7):
        with pytest.MonkeyPatch.context() as p:
            p.setattr(fingerprint, "BLOCK", block)
            got = [(r.doc_id, r.n_features, r.class_id, r.n_copies, r.n_links, r.match_id, r.match_score) for r in fingerprint.fingerprints(d).collect()]
        assert sorted(got) == sorted(want)


def test_pii_spans_lead_back_to_the_source(spark, odd, none):
    text = "Write to jane [at] example [dot] org or ｊоhn@example.com, call +1 555-123-4567 or five five five one two three four; card 4111 1111 1111 1111. Meet at noon."
    got = pii.pii(docs(spark, [(1, text, "s")])).collect()
    assert all(text[r.start : r.end] == r.found for r in got)
    assert {(r.kind, r.value) for r in got} >= {("email", "jane@example.org"), ("email", "john@example.com"), ("phone", "5551234"), ("card", "4111 1111 1111 1111")}
    masked = pii.mask(text)
    assert "example" not in masked and "Meet at noon." in masked
    assert pii.pii(odd).count() == 0 and pii.pii(none).count() == 0 and pii.mask_documents(odd).count() == odd.count()


@pytest.mark.parametrize("card", ["4111 1111 1111 1111", "5500-0000-0000-0004", "3782 822463 10005", "4111111111111111"])
@pytest.mark.parametrize("beside", ["2024-05-01", "555-123-4567", "12345", "1", "1234 5678", "20240501", "2024-05-01 12-30 7", "5500 0000 0000 0004", "99999999999999999999999"])
def test_cards_beside_other_digits(card, beside):
    for text in (f"{beside} {card}", f"{card} {beside}", f"paid {beside} {card} {beside}."):
        assert ("card", card) in {(kind, found) for kind, _, _, found in pii.find(text)}, text
        assert card not in pii.mask(text)
    assert not any(kind == "card" for kind, *_ in pii.find("99999999994111111111111111 and 4111 1111 1111 1112"))


def test_patience_is_a_common_subsequence(spark, odd, none):
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 6, 12).tolist(), rng.integers(0, 6, 15).tolist()
        pairs = license.patience(a, b)
        assert all(a[x] == b[y] for x, y in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    notice = license.TEMPLATES["GPL-3.0"].replace("licensed", "now licensed").upper()
    got = license.licenses(docs(spark, [(1, "Früh. " + notice + " End " + notice, "s")])).collect()
    assert [r.license for r in got] == ["GPL-3.0"] * 2 and all(re.match("THIS WORK", r.found) for r in got)
    assert license.licenses(odd).count() == 0 and license.licenses(none).count() == 0 and license.licenses(odd, {}).count() == 0


def test_licenses_tell_kin_apart(spark):
    t = license.TEMPLATES
    cases = {
        "Released under the BSD License.": "BSD", "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 3.0.": None,
        t["GPL-3.0"].replace("3", "2"): "GPL-2.0", t["GPL-3.0"].replace("3", "1"): None, t["GPL-3.0"].replace("General", "Lesser General"): "LGPL-3.0",
        t["GPL-2.0-header"].replace("redistribute it", "redistribute"): "GPL-2.0-header", t["Apache-2.0-header"]: "Apache-2.0-header", t["MPL-2.0-header"]: "MPL-2.0-header",
        t["CC-BY-SA-4.0-text"].replace("ShareAlike 4.0", "4.0"): None,
    } | {t[f"{x}-text"]: f"{x}-text" for x in ("MIT", "BSD-2", "BSD-3", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC-BY-SA-4.0", "CC0-1.0")}
    got = {}
    for r in license.licenses(docs(spark, [(i, f"Before it. {x} After it.", "s") for i, x in enumerate(cases)])).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert {i: got.get(i, [None]) for i in range(len(cases))} == {i: [x] for i, x in enumerate(cases.values())}


def test_toxicity_on_held_out_rows(spark, odd, none):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [f"w{x}" for x in rng.integers(0, 300, 40)] + (["vile", "awful"] if bad else [])
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(bad)))
    d, y = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    models = toxicity.train(d, y.filter("doc_id < 400"))
    got = {r.doc_id: r.rejected for r in toxicity.score(d, models).collect()}
    assert np.mean([got[i] == (i % 4 == 0) for i in range(400, 600)]) > 0.97
    assert toxicity.score(none, models).count() == 0 and toxicity.drop_rejected(odd, models).count() == odd.count()
    assert not any(r.rejected for r in toxicity.toxicity(odd, y.limit(0)).collect())
    assert not any(r.rejected for r in toxicity.score(odd, models).filter(F.col("doc_id").isin(3, 4)).collect())


def test_pipeline_stages_on_odd_documents(spark, odd, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = odd
    for _, stage in pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == odd.columns
    got = pipeline.STAGES[-1][1](spark, d, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1, 5, None}
