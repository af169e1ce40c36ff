"""Each training-data operator against brute force or known cases, and with nulls, empty and long texts, repeated rows, empty tables and further columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquire.llm import chosen_path, decontam, embedding_dedup, html_crf, lbl_lm, packing, quality_cnn, suffix_dedup, toxicity, url_rules
from sparkquire.llm.components import components

R = np.random.default_rng(4)
WORDS = ["".join(R.choice(list("abcdefgh"), R.integers(2, 7))) for _ in range(400)]


def text(n):
    return " ".join(R.choice(WORDS, n))


BASE = text(120)
PASSAGE = text(30)
TEXTS = [
    (0, BASE), (1, BASE), (2, BASE.replace(BASE.split()[60], "changed", 1)), (3, None), (4, ""), (5, text(80) + " " + PASSAGE + " " + text(40)), (6, PASSAGE + " É" + text(50)),
    (7, "x" * 5000), (8, text(3)), (9, text(6000)), (10, "word"), (10, "word"), (None, BASE), (11, PASSAGE), (12, "a\x00b" * 40), (13, "a\x00b" * 45),
]
DOC = "doc_id long, text string, lang string, score double, label int, node long, mark long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 0.5, 1, 2, 3) for i, t in TEXTS], DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def shingle_set(t):
    w = re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", (t or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_jaccard(docs, none):
    got = chosen_path.jaccard_groups(docs).collect()
    assert len(got) == len(TEXTS) and chosen_path.jaccard_groups(none).count() == 0
    sets = [(i, shingle_set(t)) for i, t in TEXTS]
    for row in got:
        if row.doc_id is None:
            assert (row.n_links, row.kept) == (0, False)
            continue
        at = next(k for k, (i, _) in enumerate(sets) if i == row.doc_id)
        mine = sets[at][1]
        links = [i for k, (i, s) in enumerate(sets) if k != at and i is not None and mine and s and len(mine & s) >= 0.8 * len(mine | s)]
        assert row.n_links == len(links) and row.group_id == min([row.doc_id, *links])


def test_large_near_group(spark):
    base = text(200).split()
    many = [(k, " ".join(base[:k] + ["new"] + base[k + 1 :])) for k in range(0, 150)]
    got = chosen_path.jaccard_groups(spark.createDataFrame(many, "doc_id long, text string"), limit=20).collect()
    sets = [shingle_set(t) for _, t in many]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    assert [r.n_links for r in sorted(got)] == want


def test_suffix_dedup(docs, none):
    got = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.removed_spans(docs).collect()}
    assert suffix_dedup.removed_spans(none).count() == 0
    for i, t in TEXTS:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        before = {x[k : k + 50] for j, y in TEXTS if i is not None and j is not None and j < i for x in [(y or "").encode()] for k in range(len(x) - 49)}
        for k in range(len(b) - 49):
            if b[k : k + 50] in before:
                gone[k : k + 50] = True
        r = got[i, len(b)]
        runs = int(np.diff(np.concatenate(([0], gone.astype(int)))).clip(0).sum())
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (gone.sum(), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)


def test_family_of_suffix_arrays():
    family, all_seen = suffix_dedup.Family(), {}
    for doc in range(40):
        t = R.integers(97, 99, 400).astype(np.uint8)
        at = np.arange(len(t) - 49)
        held = family.add(t, at, np.full(len(at), doc))
        want = [all_seen.get(t[k : k + 50].tobytes(), doc) < doc for k in at]
        assert held.tolist() == want
        for k in at:
            all_seen.setdefault(t[k : k + 50].tobytes(), doc)
    assert len(family.levels) < 10


def test_decontamination(spark, docs, none):
    w = PASSAGE.split()
    moved = " ".join(w[15:] + w[:15])
    bench = spark.createDataFrame([(1, moved), (2, text(30)), (3, None), (None, BASE), (4, " ".join(w[:3])), (1, moved)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated_pairs(docs, bench).collect())
    assert got == [(5, 1), (5, 4), (6, 1), (6, 4), (11, 1), (11, 4)]
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated_pairs(docs, bench, block_bytes=60).collect()) == got
    clean = decontam.without_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(TEXTS) - 3
    assert decontam.contaminated_pairs(none, bench).count() == 0 and decontam.contaminated_pairs(docs, bench.limit(0)).count() == 0
    assert decontam.tilings(np.arange(6, dtype="u8"), np.array([3, 4, 5, 0, 1, 2], "u8")) in ([(0, 3, 3), (3, 0, 3)], [(3, 0, 3), (0, 3, 3)])


def test_packing(spark, docs, none):
    tokens = packing.public_tokens()
    got = packing.packed(docs, tokens, keep_ids=True).collect()
    assert packing.packed(none, tokens).count() == 0
    from tokenizers import Tokenizer

    full = Tokenizer.from_str(tokens.json)
    for odd in ("<|endoftext|> a", "tab\t\n\u00a0\u2028x  ", "\U0001f600é", ""):
        assert tokens.ids(odd).tolist() == full.encode(odd, add_special_tokens=False).ids
    by = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    whole = [x for r in sorted((r for r in got if r.doc_id == 9), key=lambda r: r.piece) for x in r.ids]
    assert whole == [*full.encode(TEXTS[9][1], add_special_tokens=False).ids, 0]


def test_plan_is_near_the_bound():
    counts = np.bincount(R.integers(1, 2049, 20000), minlength=2049)
    slots, bins = packing.plan(counts)
    assert sum(counts) and bins <= 1.02 * max(np.dot(counts, np.arange(2049)) / 2048, counts[1025:].sum()) + 2


def test_scores(spark, docs, none, labels):
    for f in (toxicity.toxicity_scores, quality_cnn.quality_scores):
        rows = f(docs, labels).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
        assert f(none, labels).count() == 0 and f(docs, labels.limit(0)).count() == len(TEXTS)
    scores = toxicity.toxicity_scores(docs, labels)
    clean = toxicity.non_toxic(docs, labels)
    assert clean.columns == docs.columns and {r.score for r in clean.collect()} <= {0.5} and clean.count() == scores.where("predicted = 0").count()


@pytest.mark.parametrize(("f", "column", "least"), [(toxicity.toxicity_scores, "toxic", 0.97), (quality_cnn.quality_scores, "quality", 0.95)])
def test_held_out_accuracy(spark, f, column, least):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = f(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r[column] for r in rows]) >= least


def test_language_model(spark, docs, none):
    got = lbl_lm.lm_scores(docs).collect()
    assert len(got) == len(TEXTS) and lbl_lm.lm_scores(none).count() == 0
    token = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count: dict = {}
    for i, t in TEXTS:
        if not held(i):
            for w in token(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted(round(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in token(t)), 6) for _, t in TEXTS)
    assert np.allclose(sorted(round(r.base_score, 6) for r in got), want) and {r.train_tokens for r in got} == {n}
    model = lbl_lm.LogBilinear(np.full(lbl_lm.SYMBOLS, 1 / lbl_lm.SYMBOLS))
    a, b, z = model.tables()
    assert np.allclose(np.exp(a[3] + b[5] - z[3, 5]).sum(), 1, atol=1e-4)


def test_language_model_of_equal_batches(spark):
    rows = [(1, "one row here", "en", 0.5, 1, 2, 3), (2, "another row", "en", 0.5, 1, 2, 3), (None, None, "en", 0.5, 1, 2, 3), (None, "", "en", 0.5, 1, 2, 3)]
    once = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), DOC)
    got = lbl_lm.lm_scores(once.union(once)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1)] * 4 + [(1, 4)] * 2 + [(2, 3)] * 2
    assert {r.train_tokens for r in got} == {sum(r.n_tokens for r in got if not r.held_out)}


def test_vectors(spark):
    x = R.normal(size=(300, 16))
    x[100:200] = x[:100] + R.normal(size=(100, 16)) * 0.3
    x[200:220] = x[0]
    rows = [(k, [float(a) for a in v], "x", 1) for k, v in enumerate(x)] + [(900, None, "x", 1), (901, [0.0] * 16, "x", 1), (902, [float("nan")] * 16, "x", 1), (903, [None] * 16, "x", 1), (0, [float(a) for a in x[0]], "x", 1), (None, [1.0] * 16, "x", 1), (904, [], "x", 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string, copies int")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(v, block=16).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    assert [got[k].n_links for k in range(300)] == (near.sum(1) - 1).tolist()
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in range(900, 905)) and not got[None].kept
    assert embedding_dedup.near_vectors(v.limit(0)).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 200: 0, 100: 100, 101: 100}


def test_pages(spark):
    html = '<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>A &amp; B</h1><p>First  words here,\n long enough to be a sentence.<p>Second one, unclosed and <b>bold</b> too.</article><div class="comments"><p>Reader says hello to you all.</p></div><footer>&copy; all</footer><script>var x="<p>no</p>"</script></body></html>'
    rows = [(1, "u", html, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", "<p", 1), (4, "u", html, 1), (5, "u", "<nav>" * 3000 + html, 1)]
    got = html_crf.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    want = "A & B\nFirst words here, long enough to be a sentence.\nSecond one, unclosed and bold too."
    assert [r.text for r in got if r.page_id in (1, 4)].count(want) == 2 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]


def test_urls(spark):
    cases = [
        ("http://a.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://example.net/de/1", "example.net", "/de/1", "net/", "block"), ("x://Example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("x://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("x://b.org/fr/x", "b.org", "/fr/x", "org/fr/", "allow"), ("x://net", "net", "", None, "allow"), ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, c[0], "h", "r") for k, c in enumerate(cases)] + [(100 + k, f"http://{'spam-x' if k % 2 else 'fine'}.example.org/en/{k}", "h", "r") for k in range(60)], "page_id long, url string, host string, rule string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.judged(pages, labels).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, verdict)
    assert all(got[100 + k].verdict == ("block" if k % 2 else "allow") for k in range(60))
    silent = url_rules.judged(pages, labels.withColumn("toxic", F.lit(0))).collect()
    assert all(r.verdict == "allow" and r.mined_rule is None for r in silent if r.page_id >= 100)
    assert url_rules.judged(pages, labels.limit(0)).count() == len(got) and url_rules.judged(pages.limit(0), labels).count() == 0


def test_urls_by_every_part(spark):
    made = lambda k: [f"http://x.org/blog/{'casino-bonus' if k % 2 else 'garden-notes'}/{k}", f"http://y.org/a/{k}?q={'Pills' if k % 2 else 'rain'}&n=7"][k // 2 % 2]
    pages = spark.createDataFrame([(k, made(k)) for k in range(120)] + [(500, "http://z.org/1/2/best_casino.html"), (501, "http://z.org/1/2/best_garden.html")], "page_id long, url string")
    train = spark.createDataFrame([(made(k), bool(k % 2)) for k in range(120)], "url string, unwanted boolean")
    got = set(spark.createDataFrame([(made(0),)], "url string").select(url_rules.tokens(F.col("url"))).first()[0])
    assert {"path:blog", "path:garden-notes", "path:garden", "path:notes"} <= got and not any(t.endswith(":0") for t in got)
    rules = {r.rule: r.confidence for r in url_rules.mined(train).collect()}
    assert {"path:casino", "path:bonus", "path:casino-bonus", "value:pills"} == set(rules)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(120)], "doc_id long, quality int, toxic int")
    for how in ({}, {"block": 1}):
        got = {r.page_id: r.verdict for r in url_rules.judged(pages, labels, rules=(), **how).collect()}
        assert [got[k] for k in range(120)] == ["block" if k % 2 else "allow" for k in range(120)] and (got[500], got[501]) == ("block", "allow")
    combos = [(c & 1, c >> 1 & 1, c >> 2 & 1, c >> 3 & 1) for c in range(16)]
    rows = [("http://h/" + "/".join(n for n, on in zip(("aa", "bb", "cc", "dd"), c) if on), all(c)) for c in combos for _ in range(12)]
    assert [r.rule for r in url_rules.mined(spark.createDataFrame(rows, "url string, unwanted boolean")).collect()] == ["path:aa path:bb path:cc path:dd"]


def test_decontamination_of_short_pieces(spark):
    w = [f"w{k}" for k in range(40)]
    changed = [x if k % 5 != 4 else "other" for k, x in enumerate(w)]
    pieces = [x for k in range(36, -1, -4) for x in w[k : k + 4]]
    few = [x if k % 4 != 3 else "other" for k, x in enumerate(w)]
    texts = [changed, pieces, few, w, w[1:4] + w[:1], w[:2], ["a"] * 9, []]
    docs = spark.createDataFrame([(k, " ".join(["x", *t, "y"])) for k, t in enumerate(texts)], "doc_id long, text string")
    items = [w, w[:4], w[:2], ["a"] * 7, w[10:11], w[5:17]]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, round(r.coverage, 6)) for r in decontam.contaminated_pairs(docs, bench).collect())
    number = {x: k for k, x in enumerate(sorted({y for t in texts + items for y in t} | {"x", "y"}))}
    coded = lambda t: np.array([number[x] for x in t], "u8")
    share = lambda t, i: sum(n for _, _, n in decontam.tilings(coded(["x", *t, "y"]), coded(i))) / len(i)
    want = sorted((d, k, round(share(t, i), 6)) for d, t in enumerate(texts) for k, i in enumerate(items) if share(t, i) >= 0.8)
    assert got == want and {(0, 0, 0.8), (1, 0, 1.0)} <= set(got) and not any(d == 2 and k == 0 for d, k, _ in got)


def test_unclosed_raw_elements():
    words = lambda page: [b[0] for b in html_crf.blocks(page)]
    for name in sorted(html_crf.RAW):
        rest = [] if name in html_crf.TO_END else ["one", "two"]
        assert words(f"<p>zero</p><{name} a=b><p>one</p><{name}><p>two</p>") == ["zero", *rest]
        assert words(f"<p>zero</p><{name}>gone</{name}><p>one</p><{name}/><p>two</p>") == ["zero", "one", "two"]
