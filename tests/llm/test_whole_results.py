"""Operators against brute force where shards, blocks, slices and rounds are small, rows repeat, names clash and texts are very long."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquire.llm import chosen_path, decontam, embedding_dedup, html_crf, lbl_lm, packing, quality_cnn, suffix_dedup, toxicity, url_rules

from .test_operators import shingle_set

R = np.random.default_rng(17)
VOCABULARY = ["".join(R.choice(list("abcdefgh"), R.integers(2, 7))) for _ in range(900)]


def near(words: list[str], changes: int) -> list[str]:
    out = list(words)
    for k in R.choice(len(out), changes, replace=False):
        out[k] = f"new{R.integers(1 << 30)}"
    return out


def linked(texts: list[str], similarity: float) -> list[int]:
    sets = [shingle_set(t) for t in texts]
    n = [0] * len(sets)
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            n[a] += 1
            n[b] += 1
    return n


@pytest.mark.parametrize(("similarity", "changes"), [(0.8, (2, 3)), (0.5, (5, 7))])
def test_links_at_the_bound(spark, similarity, changes):
    texts = []
    for _ in range(120):
        words = list(R.choice(VOCABULARY, 110))
        texts += [" ".join(words), " ".join(near(words, int(R.integers(*changes))))]
    want = linked(texts, similarity)
    got = chosen_path.jaccard_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similarity=similarity, limit=4).orderBy("doc_id").collect()
    assert sum(want) >= 60 and sum(r.n_links for r in got) >= 0.99 * sum(want) and all(r.n_links <= w for r, w in zip(got, want))


def test_trees_reach_the_target():
    for n, s in itertools.product((1, 10**5, 10**8, 10**11), (0.3, 0.5, 0.8, 0.95, 1.0)):
        depth, rounds = chosen_path.tree(n, s, 1e-3)
        assert (1 - s**depth) ** (rounds * chosen_path.RUNS) <= 1e-3
    assert chosen_path.tree(10**11, 0.8, 1e-3)[0] > chosen_path.tree(10**6, 0.8, 1e-3)[0]


def test_ids_that_repeat_with_other_texts(spark):
    a = " ".join(f"w{k}" for k in range(60))
    b, c = a + " more", " ".join(f"v{k}" for k in range(60))
    rows = [(1, a), (1, b), (2, b), (2, b), (1, c), (5, c), (7, c + " end"), (3, "lone text"), (4, None), (4, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(*r, "m", 1, 2) for r in rows], "doc_id long, text string, mark string, doc int, n int").repartition(5)
    got = Counter((r.doc_id, r.n_links, r.group_id, r.kept) for r in chosen_path.jaccard_groups(docs).collect())
    assert got == Counter({(1, 3, 1, True): 2, (2, 3, 1, False): 2, (1, 2, 1, True): 1, (5, 2, 1, False): 1, (7, 2, 1, False): 1, (3, 0, 3, True): 1, (4, 0, 4, True): 2, (None, 0, None, False): 2})
    one = [sorted(map(str, chosen_path.one_of_each_group(docs.repartition(n)).collect())) for n in (1, 6)]
    assert one[0] == one[1] and len(one[0]) == 7 and chosen_path.one_of_each_group(docs).columns == docs.columns
    assert Counter(r.doc_id for r in chosen_path.one_of_each_group(docs).collect()) == Counter({1: 2, 3: 1, 4: 2, None: 2})
    assert chosen_path.one_of_each_group(docs.limit(0)).count() == 0


def brute_spans(rows):
    held, out = {}, {}
    for doc, b in rows:
        for k in range(len(b) - 49):
            held[b[k : k + 50]] = min(doc, held.get(b[k : k + 50], doc))
    for doc, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if held[b[k : k + 50]] < doc:
                gone[k : k + 50] = True
        out[doc] = int(gone.sum())
    return out


def test_shards_are_divided_and_hot_anchors_split(spark):
    line = "a line that very many of the documents hold somewhere in their text, word for word"
    texts = [" ".join([*R.choice(VOCABULARY, 20), line, *R.choice(VOCABULARY, 15)]) for _ in range(60)] + ["    " * 40, "\x00" * 70, "é" * 60, "x" * 49]
    texts += [t[10:] for t in texts[:10]]
    docs = spark.createDataFrame([(k, t, 1, "s") for k, t in enumerate(texts)], "doc_id long, text string, mark int, spans string").repartition(6)
    want = brute_spans([(k, t.encode()) for k, t in enumerate(texts)])
    keyed = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    assert len(suffix_dedup._hot(keyed, 300, 1)) > 0
    for how in ({}, {"shard_bytes": 300, "sample": 1}, {"shard_bytes": 300, "fan": 8, "sample": 1}, {"shard_bytes": 100, "fan": 3}):
        got = {r.doc_id: r.n_removed for r in suffix_dedup.removed_spans(docs, **how).collect()}
        assert got == want
        kept = suffix_dedup.without_repeats(docs, **how)
        assert kept.columns == docs.columns and kept.count() == len(texts) and {r.spans for r in kept.collect()} == {"s"}


def test_texts_of_several_slices(spark):
    long = bytes(R.integers(97, 123, 9_500_000, dtype=np.uint8)).decode()
    again, edge = long[4_194_250:4_194_400], long[-80:]
    rows = [(1, long), (2, "q" * 30 + again + "r" * 30), (3, long[:60] + "Z" + edge), (4, long[:5_000_000])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.removed_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (150, 1), 3: (140, 2), 4: (5_000_000, 1)}


def test_model_depends_on_rows_alone(spark):
    texts = [" ".join(R.choice(VOCABULARY[:60], int(n))) for n in R.integers(0, 200, 150)] + [None, "", "x " * 300_000]
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, row_id int")
    scores = lambda d: {(r.doc_id, r.n_tokens): (r.score, r.base_score, r.train_tokens) for r in lbl_lm.lm_scores(d, block_bytes=20_000).collect()}
    few, many = scores(docs.repartition(2)), scores(docs.repartition(9))
    assert few.keys() == many.keys() and len(few) == len(texts) and all(np.allclose(few[k], many[k], rtol=1e-9) for k in few)
    assert (len(texts) - 1, 300_001) in few
    twice = lbl_lm.lm_scores(docs.union(docs)).collect()
    assert len(twice) == 2 * len(texts) and all(n == 2 for n in Counter((r.doc_id, r.score) for r in twice).values())


def test_model_beats_the_base(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lbl_lm.lm_scores(d).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_runs_of_tokens():
    import pyarrow as pa

    sizes = [0, 5, lbl_lm.RUN * 2 + 7, 1, lbl_lm.RUN, 3]
    symbols = [R.integers(0, 1000, n).astype(np.int16) for n in sizes]
    got = [np.concatenate(x) for x in zip(*lbl_lm.token_runs(pa.table({"symbols": [s.tobytes() for s in symbols]})))]
    want = lbl_lm.sequences(np.concatenate(symbols), np.array(sizes))
    assert all((a == b).all() for a, b in zip(got, want))


def test_vectors_near_the_bound(spark):
    n = 1500
    x, y = R.normal(size=(n, 64)), R.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    c = R.uniform(0.9, 0.92, n)[:, None]
    u = np.concatenate([x, c * x + np.sqrt(1 - c * c) * y, c[:20] * x[0] + np.sqrt(1 - c[:20] ** 2) * y[:20]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    got = embedding_dedup.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(u)], "vec_id long, embedding array<double>"), block=16).collect()
    want = (u @ u.T >= 0.9).sum() - len(u)
    assert want >= 2 * n - 2 and 0.99 * want <= sum(r.n_links for r in got) <= want + 2


def test_sketches_keep_near_vectors():
    p = np.arccos(0.9) / np.pi
    most = embedding_dedup.sketch_bound(0.9, 1e-5)
    assert (R.binomial(embedding_dedup.SKETCH, p, 200_000) <= most).all() and most < embedding_dedup.SKETCH // 2


@pytest.mark.parametrize("size", [3, 4])
def test_shuffled_blocks_of_items(spark, size):
    docs, items = [], []
    for k in range(25):
        words = list(R.choice(VOCABULARY, 24, replace=False))
        parts = [words[a : a + size] for a in range(0, 24, size)]
        items.append((k, " ".join(words)))
        docs.append((k, " ".join([*R.choice(VOCABULARY, 10), *(w for j in R.permutation(len(parts)) for w in parts[j]), *R.choice(VOCABULARY, 10)]), True))
    frame = spark.createDataFrame(docs + [(100, "contaminated words only", False)], "doc_id long, text string, contaminated boolean")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated_pairs(frame, bench).collect()}
    assert {(k, k) for k in range(25)} <= got
    clean = decontam.without_contaminated(frame, bench)
    assert clean.columns == frame.columns and [tuple(r) for r in clean.collect()] == [(100, "contaminated words only", False)]


def test_ids_of_every_text(spark):
    from tokenizers import Tokenizer

    tokens = packing.public_tokens()
    full = Tokenizer.from_str(tokens.json)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text, want in zip(texts, full.encode_batch(texts, add_special_tokens=False)):
        assert tokens.ids(text).tolist() == want.ids


def test_equal_pieces_have_places_of_their_own(spark):
    rows = [(1, "same words")] * 500 + [(None, None)] * 300 + [(k, "w " * (k * 37)) for k in range(60)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    spots = Counter()
    for r in got:
        spots.update((r.sequence_id, r.offset + k) for k in range(r.length))
    assert max(spots.values()) == 1 and all(at < 2048 for _, at in spots)
    assert len({s for s, _ in spots}) <= -(-len(spots) // 2048) + 2


def best_bins(counts: dict[int, int], cap: int) -> int:
    """The fewest bins, by search over all ways to fill them."""
    items = sorted((n for n, k in counts.items() for _ in range(k)), reverse=True)
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[k] <= cap and bins[j] not in bins[:j]:
                place(k + 1, [*bins[:j], bins[j] + items[k], *bins[j + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best


def test_plans_against_all_plans():
    for _ in range(60):
        counts = np.bincount(R.integers(1, 13, 9), minlength=13)
        _, bins = packing.plan(counts)
        assert bins <= best_bins({n: int(k) for n, k in enumerate(counts) if k}, 12) + 1


def test_rules_against_all_itemsets(spark):
    urls = [("http://h.org/" + "/".join(x for x in ("red", "blue", "tall", "old") if R.random() < 0.5) + f"/{k}", None) for k in range(160)]
    urls = [(u, ("red" in u and "tall" in u) or R.random() < 0.05) for u, _ in urls]
    frame = spark.createDataFrame(urls, "url string, unwanted boolean")
    sets = [(set(r.t), r.unwanted) for r in frame.select(url_rules.tokens(F.col("url")).alias("t"), "unwanted").collect()]
    every, base = sorted(set().union(*(s for s, _ in sets))), sum(y for _, y in sets) / len(sets)
    least, rules = 10, {}
    for n in range(1, len(every) + 1):
        for some in itertools.combinations(every, n):
            hit = [y for s, y in sets if set(some) <= s]
            if sum(hit) >= least and sum(hit) / len(hit) >= 0.8 and sum(hit) / len(hit) > base:
                rules[some] = sum(hit) / len(hit)
    shorter = lambda r: any(rules.get(tuple(x for x in r if x != y), 0) >= rules[r] for y in r)
    want = {" ".join(r): round(c, 9) for r, c in rules.items() if not shorter(r)}
    assert want and {r.rule: round(r.confidence, 9) for r in url_rules.mined(frame).collect()} == want
    pages = spark.createDataFrame([(k, u, "x", "y") for k, (u, _) in enumerate(urls)], "page_id long, url string, tokens string, given string")
    labels = spark.createDataFrame([(k, 1, int(y)) for k, (_, y) in enumerate(urls)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.judged(pages, labels, rules=()).collect()}
    assert got == {k: "block" if any(set(r.split()) <= s for r in want) else "allow" for k, (s, _) in enumerate(sets)}


def test_stray_quotes_stay_in_their_tag():
    words = lambda page: [b[0] for b in html_crf.blocks(page)]
    assert words('<p class="x>Some long text</p><p class="y">Next</p>') == ["Some long text", "Next"]
    assert words("<p title='it's'>Alpha</p>") == ["Alpha"]
    assert words('<p title="a > b">C</p><div data-x="<p>no</p>" id=q>D</div>') == ["C", "D"]
    assert words("a <b and") == ["a"] and words("1 < 2 and 3 > 2") == ["1 < 2 and 3 > 2"]


@pytest.mark.parametrize(("template", "least"), [("manual", 0.95), ("bare", 0.95), ("layout", 0.9), ("news", 0.9)])
def test_pages_of_a_template_never_trained_on(template, least):
    others = tuple(t for t in html_crf.TEMPLATES if t != template)
    assert html_crf.accuracy(html_crf.fitted(1200, others), 60, (template,)) >= least


def test_viterbi_against_all_labellings():
    crf = html_crf.CRF(R.normal(size=(2, (1 << html_crf.BITS) + 1)), R.normal(size=(3, 2)))
    for n in range(1, 8):
        row, column = np.repeat(np.arange(n), 3), R.integers(0, 1 << html_crf.BITS, 3 * n)
        u = crf.unary(row, column, n)
        score = lambda y: u[np.arange(n), y].sum() + crf.t[2, y[0]] + sum(crf.t[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert crf.decode(row, column, n).astype(int).tolist() == list(best)


def test_long_texts_are_scored_whole(spark):
    net, data = quality_cnn.Net(), R.integers(32, 127, 2_000_000).astype(np.uint8)
    got = net.scores(data, np.array([0, 1_500_000, 2_000_000]))
    doc, begin = quality_cnn.places(np.array([0, 1_500_000, 2_000_000]))
    x = quality_cnn.pieces(data, np.array([0, 1_500_000, 2_000_000]), doc, begin)
    h = np.maximum(net.highest(x, False)[0] + net.p["bias"], 0)
    assert np.allclose(got, net.top(h, np.searchsorted(doc, [0, 1]))[2], atol=1e-5)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(k, ("bad words here " if k % 2 else "good calm text ") * (100_000 if k == 39 else 5)) for k in range(40)], "doc_id long, text string")
    assert toxicity.toxicity_scores(docs, labels).count() == quality_cnn.quality_scores(docs, labels).count() == 40

