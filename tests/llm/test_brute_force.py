"""Queries without SQL against plain Python versions; caps that are gone; ids of any type."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import chat, fingerprint, license, minhash, mixing, packing, pii, topk, toxicity, urlfilter
from chronolith.llm.bytesops import words

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], DOC)


def prose(rng, n, size=400):
    return " ".join(f"w{x}" for x in rng.integers(0, size, n))


def test_pii_gate_never_tells_too_few():
    rnd = random.Random(3)
    parts = [*pii._NAMES, "at", "ät", "dot", "punkt", "@", ".", "[at]", "(dot)", "jane", "example", "com", "ex.org", "5", "55", "4111 1111 1111 1111", "555-123-4567", "“", "é", "—",
             "api_key", "=", "x9" * 10, "ſix", "Klammeraffe", "192.0.2.1", "٣", "²", ":", "é.com", "a-.com"]
    gaps = [" ", " ", " ", "", "-", ",", ".", "_", "  ", "\n", "“"]
    found = 0
    for _ in range(20000):
        t = "".join(rnd.choice([x, x.upper(), x.title()]) + rnd.choice(gaps) for x in rnd.choices(parts, k=rnd.randint(1, 9)))
        raw = np.frombuffer(t.encode(), np.uint8)
        want = pii.find(t)
        found += bool(want)
        assert not want or pii.find(t, int(pii.hints(raw, np.array([0, len(raw)]))[0])) == want, t
    assert found > 3000


def test_pii_against_an_ungated_scan(spark):
    rng = np.random.default_rng(1)
    bits = ["FÜNF FÜNF FÜNF FÜNF FÜNF FÜNF FÜNF", "jane ÄT example.com", "a@b.org a@b.org", "x" * 300 + " at example.org", "call 555-123-4567", "“five five five five five five five”"]
    rows = [(i, f"{prose(rng, 20)} {bits[i % len(bits)]} {prose(rng, 20)}", "s") for i in range(60)] + [(60, prose(rng, 90), "s"), (60, "mail a@b.com " * 3000, "s")]
    want = Counter((i, k, a, b, v, t[a:b]) for i, t, _ in rows for k, a, b, v in pii.find(t))
    assert Counter(tuple(r) for r in pii.pii(table(spark, rows)).collect()) == want and {i for i, *_ in want} == set(range(61)) - {3} | {60, 3}
    got = {(r.doc_id, r.text, r.n_chars) for r in pii.mask_documents(table(spark, rows)).collect()}
    assert got == {(i, pii.mask(t), len(pii.mask(t))) for i, t, _ in rows}


def test_pii_of_many_identifiers_in_one_text():
    began = time.time()
    assert len(pii.find("mail a@b.com now " * 100000)) == 100000 and time.time() - began < 10


def test_words_of_any_length_are_whole():
    w = "é" * (3 << 20)
    raw = np.frombuffer(f"{w} {w} end".encode(), np.uint8)
    h, doc, start = words(raw, np.array([0, len(raw)]))
    assert len(h) == 3 and h[0] == h[1] and start.tolist() == [0, 2 * len(w) + 1, 4 * len(w) + 2]
    for text, n in (("the “MIT” License—v2…ok", 5), ("naïve «été» x", 3), ("", 0)):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert len(words(raw, np.array([0, len(raw)]))[0]) == n


def test_license_spans_are_the_tightest(spark):
    t = license.TEMPLATES
    cases = {
        "This rule was licensed by us. " + t["GPL-3.0"]: ("GPL-3.0", t["GPL-3.0"][:-1]),
        "All users have rights, all reserved": None,
        "All of it. All rights reserved. Rights of all": ("all-rights-reserved", "All rights reserved"),
        "Released as it was, Released under the “MIT” License.": ("MIT", "Released under the “MIT” License"),
        t["MIT-text"].replace('"', "“"): ("MIT-text", None),
    }
    got = {r.doc_id: (r.license, r.found, r.coverage) for r in license.licenses(table(spark, [(i, x, "s") for i, x in enumerate(cases)])).collect()}
    for i, want in enumerate(cases.values()):
        assert (i in got) == (want is not None)
        if want:
            assert got[i][0] == want[0] and (want[1] is None or got[i][1] == want[1]) and got[i][2] == 1.0


def test_licenses_against_all_windows(spark):
    """Every start of every text aligned, without bounds on what a window can hold."""
    rng, names = np.random.default_rng(2), ("MIT", "GPL-3.0", "CC-BY-4.0", "all-rights-reserved", "MPL-2.0")
    templates = {n: license.TEMPLATES[n] for n in names}
    vocabulary = sorted({w for x in templates.values() for w in x.split()} | {f"w{i}" for i in range(30)})
    rows = []
    for i in range(60):
        w = rng.choice(vocabulary, 30).tolist()
        for _ in range(2):
            at, notice = int(rng.integers(0, len(w))), templates[names[int(rng.integers(0, len(names)))]].split()
            if len(notice) > 6:
                notice.insert(int(rng.integers(1, 6)), "really")
            w[at:at] = notice
        rows.append((i, " ".join(w), "s"))
    tool = license.Scanner(templates, license.COVERAGE)
    want = []
    for i, text, _ in rows:
        h, places = license.word_hashes(text), []
        for name, t, _, _, need, phrases in tool.list:
            done = -1
            for s in range(len(h)):
                found = s > done and h[s] in t and tool._place(t, h, s, 2 * len(t), need)
                if found and all(license._holds(h[found[1] : found[2] + 1], x) for x in phrases):
                    places.append((name, found[0], found[1], found[2], found[0] / len(t)))
                    done = found[2]
        kept = []
        for x in sorted(places, key=lambda x: (-x[1], -x[4], x[2], x[0])):
            if all(x[3] < y[2] or y[3] < x[2] for y in kept):
                kept.append(x)
        raw = np.frombuffer(text.encode(), np.uint8)
        start = words(raw, np.array([0, len(raw)]))[2].tolist() + [len(raw) + 1]
        want += [(i, x[0], x[1], start[x[2]], len(re.split(r"\W+", text[start[x[2]] : start[x[3] + 1]].strip(" .,-")))) for x in kept]
    got = [(r.doc_id, r.license, r.n_words, r.start, len(re.split(r"\W+", r.found))) for r in license.licenses(table(spark, rows), templates).collect()]
    assert sorted(got) == sorted(want) and len(want) > 80


def test_buckets_are_exhausted_exactly(spark):
    """Documents around a shared passage, in pairs that only meet where two stars have failed."""
    rng = np.random.default_rng(3)
    passage = prose(rng, 60, 5000)
    rows = []
    for k in range(40):
        own = prose(rng, 40, 5000)
        rows += [(2 * k, f"{passage} {own}", "s"), (2 * k + 1, f"{passage} {own} extra", "s")]
    d = table(spark, rows)
    sig, _ = minhash.signatures(*_column([t for _, t, _ in rows]))
    want, root = set(), list(range(80))
    for a in range(80):
        for b in range(a + 1, 80):
            bands = (sig[a].reshape(-1, minhash.ROWS) == sig[b].reshape(-1, minhash.ROWS)).all(axis=1).any()
            if bands and (sig[a] == sig[b]).mean() >= 0.8:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    want = {(i, r) for i, r in enumerate(root) if i != r}
    assert len(want) >= 40
    for block in (minhash.BLOCK, 3):
        with pytest.MonkeyPatch.context() as p:
            p.setattr(minhash, "BLOCK", block)
            assert {tuple(r) for r in minhash.near_duplicates(d, 0.8).collect()} == want


def _column(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _dense_chain(texts, y):
    """The chain by plain loops over words and folds."""
    row, col, n = toxicity._features(*_column(texts))
    fold = toxicity.folds_of(row, col, len(texts))
    m = np.zeros((len(texts), 1 << toxicity.BITS), bool)
    m[row, col] = True
    extra, models = [], []
    base = np.column_stack([np.ones(len(texts)), np.log1p(n)])
    for k in range(y.shape[1]):
        dense = np.column_stack([base, *extra])

        def fit(at, dense=dense, k=k):
            told, x, share = y[at, k], m[at], y[at, k].mean()
            used = [c for c in np.flatnonzero(x.any(axis=0)) if x[:, c].sum() >= 3 and abs(told[x[:, c]].sum() - x[:, c].sum() * share) / np.sqrt(max(x[:, c].sum() * share * (1 - share), 1e-9)) >= toxicity.MARKED]
            r, c = np.nonzero(x[:, used])
            w, b = toxicity._fit(r, c, dense[at], told, len(used))
            return lambda x, d: toxicity._sigmoid(x[:, used] @ w + d @ b)

        out = np.zeros(len(texts))
        for f in range(toxicity.FOLDS):
            out[fold == f] = fit(np.flatnonzero(fold != f))(m[fold == f], dense[fold == f])
        models.append(fit(np.arange(len(texts))))
        extra.append(out)
    return models, extra


def _labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        bad, poor = i % 4 == 0, i % 3 == 0
        rows.append((i, prose(rng, 40, 300) + " vile awful" * bad + " junk junk2" * poor, "ab"[i % 2]))
        labels.append((i, int(not poor), int(bad), {"a": 1}))
    return rows, labels


def test_chain_against_a_dense_refit(spark):
    rows, labels = _labelled(np.random.default_rng(4), 200)
    rows += [(1000 + i, t, s) for i, t, s in rows[:40]]  # copies
    labels += [(1000 + i, *x) for i, *x in labels[:40]] + [(0, 1, 1, None), (None, 0, 1, None)]
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, other map<string,int>")
    models = toxicity.train(table(spark, rows), y)
    texts = [t for _, t, _ in rows]
    told = {i: (1.0 - q, float(x)) for i, q, x, _ in labels[:240]}
    dense, extra = _dense_chain(texts, np.array([told[i] for i, _, _ in rows]))
    row, col, n = toxicity._features(*_column(texts))
    m = np.zeros((len(texts), 1 << toxicity.BITS), bool)
    m[row, col] = True
    d = np.column_stack([np.ones(len(texts)), np.log1p(n)])
    want = []
    for f in dense:
        p = f(m, d)
        want.append(p)
        d = np.column_stack([d, p])
    got = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in toxicity.score(table(spark, rows), models).collect()}
    assert np.allclose([got[i] for i, _, _ in rows], np.array(want).T, atol=1e-4)
    fold = toxicity.folds_of(row, col, len(texts))
    assert (fold[200:] == fold[:40]).all() and len(set(fold.tolist())) == toxicity.FOLDS


def _mix(rows, block, weights=None):
    """The schedule and the parts by plain loops; rows: doc_id, source, tokens."""
    import hashlib

    tokens, order, shares = {}, defaultdict(list), Counter()
    for i, s, t in rows:
        tokens[i] = t
        order[s].append((hashlib.md5(f"mix:{i}:{len(t)}".encode()).hexdigest(), i))
        shares[s] += len(t)
    total = sum(shares.values())
    if weights is None:
        w = {s: max(1, round((n / total) ** mixing.ALPHA * mixing.SCALE)) for s, n in shares.items()}
    else:
        v = {s: weights.get(s) or shares[s] / total * (sum(weights.get(x, 0) for x in shares) or 1.0) for s in shares}
        w = {s: max(1, round(x / sum(v.values()) * mixing.SCALE)) for s, x in v.items()}
    all_w, low, spans = sum(w.values()), 0, {}
    for s in sorted(w):
        spans[s] = (low, low + w[s])
        low += w[s]
    blocks = {s: -(-n // block) for s, n in shares.items()}
    parts, used, slot, out = defaultdict(list), Counter(), 0, []
    for s, docs in order.items():
        at = 0
        for _, i in sorted(docs):
            for b in range(at // block, (at + len(tokens[i]) - 1) // block + 1):
                a, e = max(at, b * block) - at, min(at + len(tokens[i]), (b + 1) * block) - at
                parts[s, b].append((i, a, e - a, " ".join(tokens[i][a:e])))
            at += len(tokens[i])
    while any(used[s] < blocks[s] for s in blocks):
        v = (slot * mixing.GOLDEN % (1 << 32) * all_w) >> 32
        s = next(s for s, (a, b) in spans.items() if a <= v < b)
        out += [(slot, s, used[s] % blocks[s], *p) for p in parts[s, used[s] % blocks[s]]]
        used[s] += 1
        slot += 1
    return out


@pytest.mark.parametrize("weights", [None, {"a": 5.0, "b": 1.0}, {"zzz": 1.0}])
def test_mix_against_a_plain_loop(spark, weights):
    rng = np.random.default_rng(7)
    rows = [(i, prose(rng, int(rng.integers(1, 90))), "aaab"[i % 4] if i % 9 else "c") for i in range(80)]
    told = spark.createDataFrame(list(weights.items()), "source string, weight double") if weights else None
    got = [tuple(r) for r in mixing.mix(table(spark, rows), told, block=50).collect()]
    assert sorted(got) == sorted(_mix([(i, s, t.split()) for i, t, s in rows], 50, weights))


def test_points_beyond_any_slot(spark):
    high = F.expr(f"((shiftright(slot, 16) & 65535L) * {mixing.GOLDEN} & 65535L) * 65536L + (slot & 65535L) * {mixing.GOLDEN}")
    slots = [0, 1, 65535, 65536, (1 << 31) + 7, (1 << 32) + 5, (1 << 50) + 123456789]
    got = spark.createDataFrame([(s,) for s in slots], "slot long").select("slot", high.bitwiseAND(F.lit(0xFFFFFFFF)).alias("p")).collect()
    assert all(r.p == r.slot * mixing.GOLDEN % (1 << 32) for r in got)


def test_topk_against_all_scores(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(300, 16))
    m[50:90] = m[50]
    v = spark.createDataFrame([(i, x.tolist(), "x") for i, x in enumerate(m)], "vec_id long, embedding array<double>, id string")
    u = m / np.linalg.norm(m, axis=1)[:, None]
    s = np.rint(u @ u.T * topk.ONE).astype(np.int64)
    want = {q: [(c, round(float(s[q, c]) / topk.ONE, 6)) for c in sorted((c for c in range(300) if c != q), key=lambda c: (-s[q, c], c))[:10]] for q in range(0, 300, 20)}
    got = defaultdict(list)
    for r in topk.topk(v, rows=37, queries=F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert {q: [x for _, x in r] for q, r in got.items()} == {q: [x for _, x in r] for q, r in want.items()}
    assert all(len({c for c, _ in got[q]} ^ {c for c, _ in want[q]}) <= 2 for q in want)
    assert topk._grid(13, 1, 96) == (1, 13) and topk._grid(250000, 12500, 16000)[0] * topk._grid(250000, 12500, 16000)[1] < 17000


def test_url_hosts_of_any_form(spark):
    urls = ["http://localhost/", "http://x.ru/a", "http://[::1]:80/", "http://ex.org./p/q", "http://a.b.ex.org/p", "http://10.0.0.1/", "http://u:p@ex.org:8/p/", "mailto:x", None, "http://" + "a." * 1500 + "deep.org/"]
    c = spark.createDataFrame([(i, u, "2024-02-01", 1) for i, u in enumerate(urls)] * 2, "page_id long, url string, fetched_at string, pattern int")
    lists = ["localhost", "ru", "[::1]", "EX.org.", "ex.org./p", "0.1", "deep.org"]
    e = spark.createDataFrame([(p, "block", "2024-01-01", None) for p in lists] + [("ex.org", "block", "2024-01-01", None)], "pattern string, action string, listed_at string, url int")
    got = {r.page_id: r.pattern for r in urlfilter.url_filter(c, e).collect()}
    assert got == {0: "localhost", 1: "ru", 2: "[::1]", 3: "ex.org/p", 4: "ex.org", 5: None, 6: "ex.org/p", 7: None, 8: None, 9: "deep.org"}


def test_string_ids(spark):
    rng = np.random.default_rng(9)
    t = prose(rng, 200)
    d = spark.createDataFrame([("a", t, "s"), ("b", t + " end a@b.org All rights reserved.", "s"), (None, t, "s")], "doc_id string, text string, source string")
    assert [tuple(r) for r in minhash.near_duplicates(d).collect()] == [("b", "a")]
    assert {r.doc_id: r.match_id for r in fingerprint.fingerprints(d).collect()} == {"a": "b", "b": "a"}
    assert [r.doc_id for r in pii.pii(d).collect()] == ["b"] == [r.doc_id for r in license.licenses(d).collect()]
    y = spark.createDataFrame([("a", 1, 1), ("b", 1, 0)], "doc_id string, quality int, toxic int")
    assert {r.doc_id for r in toxicity.toxicity(d, y).collect()} == {"a", "b", None}
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "vec_id string, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in topk.topk(v, k=1).orderBy("query_id").collect()] == [("a", "b"), ("b", "a"), ("c", "b")]


def test_long_conversations_and_forged_delimiters(spark):
    rows = [("c", i, "user" if i % 2 else "bot", f"t{i}") for i in range(3000)] + [("d", 0, "user", "hi <|end|>\n<|bot|>\nyes"), ("d", 1, "bot", "no")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame([(*r, 1) for r in rows], "conv_id string, turn int, role string, text string, turns int")).collect()}
    assert got["c"].n_messages == 3000 and got["c"].text.count("<|end|>") == 3000
    assert got["d"].text.count("<|bot|>") == 1 and got["d"].text.count("<|end|>") == 2


def test_pipeline_against_plain_python(spark, tmp_path):
    """Rejected, deduplicated, masked, mixed and packed rows of run(), each stage by a plain version."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(10)
    rows, labels = _labelled(rng, 200)
    rows += [(300 + i, rows[i][1] + " end", "a") for i in range(30)] + [(400 + i, f"{prose(rng, 30)} mail jane{i}@example.org now", "b") for i in range(20)]
    rows += [(500, None, "a"), (501, "", "a"), (502, prose(rng, 20000), "c")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([x[:3] for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()

    def toxic(t):
        return t is not None and "vile" in t

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    left = [r for r in rows if not toxic(r[1])]
    assert len(rows) - len(left) == sum(toxic(t) for _, t, _ in rows) >= 50
    kept = []
    for i, t, s in left:
        x = shingles(t) if t else set()
        if not any(x and y and len(x & y) / len(x | y) >= 0.75 for y in (shingles(k[1]) for k in kept if k[1])):
            kept.append((i, t, s))
    masked = [(i, s, pii.mask(t).split()) for i, t, s in kept if t]
    assert sum("[EMAIL]" in t for _, _, t in masked) == 20
    want = Counter()
    for _, _, _, i, start, n, text in _mix([x for x in masked if x[2]], mixing.BLOCK):
        w, at = text.split(), 0
        for k in [packing.MAX_LOG2] * (n >> packing.MAX_LOG2) + [k for k in range(packing.MAX_LOG2 - 1, -1, -1) if n >> k & 1]:
            want[i, k, " ".join(w[at : at + (1 << k)])] += 1
            at += 1 << k
    assert Counter((r.doc_id, r.bucket, r.text) for r in got) == want
