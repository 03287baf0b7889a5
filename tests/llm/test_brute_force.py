"""Operators that SQL cannot say, against plain Python of another make; stated values; columns that clash."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, chunks, decontaminate, jaccard_join, language, line_rules, quality, severity, token_counts, url_filter

SMALL = "/root/testdata/sf0.001"


def words(seed, n, letters="abcdefghij"):
    draw = random.Random(seed)
    return ["".join(draw.choice(letters) for _ in range(draw.randint(2, 7))) for _ in range(n)]


# -- operator 1 --------------------------------------------------------------------------------------------


def test_labellers_recover_planted_accuracies():
    """Votes drawn from known error rates: the posterior orders patterns as the true odds do."""
    draw = random.Random(1)
    wrong = [0.02, 0.05, 0.1, 0.2, 0.02, 0.05, 0.1, 0.2, 0.05]
    counts = Counter()
    for _ in range(20_000):
        good = draw.random() < 0.7
        counts["".join("-" if draw.random() < 0.3 else "gb"[(draw.random() < w) == good] for w in wrong)] += 1
    found = quality.fit_labellers(counts)

    def truth(pattern):
        odds = math.log(0.7 / 0.3)
        for vote, w in zip(pattern, wrong):
            odds += {"g": math.log((1 - w) / w), "b": math.log(w / (1 - w)), "-": 0.0}[vote]
        return 1 / (1 + math.exp(-odds))

    miss = sum(n * ((found[p] >= 0.5) != (truth(p) >= 0.5)) for p, n in counts.items())
    assert miss < 0.01 * sum(counts.values())


def test_pattern_counts_cover_all_rows(spark, monkeypatch):
    """The labeller model is fitted on the votes of every text with a word, counted in plain Python."""
    seen = []
    monkeypatch.setattr(quality, "fit_labellers", lambda counts: seen.append(counts) or {p: 0.9 for p in counts})
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    quality.fit(docs)
    want = Counter(quality.votes(r["text"].encode()) for r in docs.collect() if r["text"] and r["text"].strip())
    assert seen == [dict(want)]


# -- operator 4 --------------------------------------------------------------------------------------------


def test_proportions_equal_a_grid_search():
    draw = np.random.default_rng(2)
    rates = draw.dirichlet(np.full(50, 0.3), 3) + 1e-6
    rates /= rates.sum(1, keepdims=True)
    for share in (0.5, 0.75, 0.9):
        grams = np.concatenate([draw.choice(50, int(6_000 * share), p=rates[0]), draw.choice(50, int(6_000 * (1 - share)), p=rates[2])])
        found = language.infer(grams, np.log(rates))
        assert set(found) == {0, 2}
        weight = np.bincount(grams, minlength=50)
        grid = np.linspace(0.001, 0.999, 999)
        best = grid[np.argmax([weight @ np.log(g * rates[0] + (1 - g) * rates[2]) for g in grid])]
        assert found[0] == pytest.approx(best, abs=0.02)


def test_ngram_rates_equal_plain_counts(spark):
    rows = [("en", "the cat"), ("en", "The  hat!"), ("de", "der Hut"), (None, "x"), ("de", None), ("fr", "12")]
    langs, rates = language.fit(spark.createDataFrame(rows, "lang STRING, text STRING"))
    assert langs == ["de", "en"]
    for k, lang in enumerate(langs):
        counts = np.full(rates.shape[1], language.SMOOTHING)
        for own, text in rows:
            if own == lang and text:
                for g in language.ngrams(text):
                    counts[g] += 1
        assert np.allclose(rates[k], np.log(counts / counts.sum()))


# -- operator 5 --------------------------------------------------------------------------------------------


def test_cut_passages_stand_elsewhere_and_none_is_missed(spark):
    """Every 51-word passage that an earlier text holds is cut by half at least; every cut word stands in a run of
    MIN_WORDS words that an earlier text, or an earlier place, holds too."""
    draw, rows = random.Random(5), []
    shared = [words(900 + k, draw.choice([51, 60, 120, 400])) for k in range(6)]
    for k in range(120):
        text = words(k, draw.randint(5, 300))
        for passage in draw.sample(shared, draw.choice([0, 1, 1, 2])):
            at = draw.randrange(len(text) + 1)
            text[at:at] = passage
        rows.append((k, " ".join(text)))
    rows += [(200 + k, " ".join(shared[0])) for k in range(40)]
    found = {r["doc_id"]: r for r in chunks.dedup(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    before, long_before = set(), set()
    for doc, text in rows:
        own = text.split()
        starts, at = [], 0
        for w in own:
            starts.append(at)
            at += len(w) + 1
        cut = {k for s in found[doc]["_spans"] for k, a in enumerate(starts) if s["start"] <= a < s["end"]}
        runs = [tuple(own[k:k + chunks.MIN_WORDS]) for k in range(len(own) - chunks.MIN_WORDS + 1)]
        times = Counter(runs)
        known = {k + j for k, r in enumerate(runs) if r in before or times[r] > 1 for j in range(chunks.MIN_WORDS)}
        assert cut <= known, doc
        for k in range(len(own) - 50):
            if tuple(own[k:k + 51]) in long_before:
                assert len(cut & set(range(k, k + 51))) >= 24, (doc, k)
        before |= set(runs)
        long_before |= {tuple(own[k:k + 51]) for k in range(len(own) - 50)}
        spans = [(s["start"], s["end"]) for s in found[doc]["_spans"]]
        left = "".join(text[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(text)]))
        assert found[doc]["text"] == left


# -- operator 6 --------------------------------------------------------------------------------------------


def test_joins_equal_the_look_up_in_tasks(spark):
    draw = random.Random(6)
    pool = words(66, 40)
    items = [(k, " ".join(draw.choice(pool) for _ in range(draw.choice([0, 1, 2, 5, 12, 13, 14, 30])))) for k in range(60)]
    items += [(0, items[1][1]), (None, "x"), (99, None), (100, "Wörter, ABER & mehr!")]
    docs = [(draw.choice([k, 1, None]), " ".join(
        (draw.choice(items)[1] or "") if draw.random() < 0.4 else draw.choice(pool) for _ in range(draw.randint(0, 30)))) for k in range(120)]
    docs += [(1, None), (2, ""), (3, "x Wörter aber MEHR wörter"), (3, "x Wörter aber MEHR wörter")]
    frame, bench = spark.createDataFrame(docs, "doc_id LONG, text STRING"), spark.createDataFrame(items, "item_id LONG, text STRING")

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    one, two = (rows(decontaminate.report(frame, bench, block_bytes=size)) for size in (2 ** 30, 0))
    assert one == two and sum(r[-1] for r in one) > 10
    assert rows(decontaminate.keep_clean(frame, bench, block_bytes=0)) == rows(decontaminate.keep_clean(frame, bench))


def test_steps_do_not_grow_with_the_items(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    for size in (2 ** 30, 20_000, 0):
        plan = decontaminate.scan(docs, items, block_bytes=size)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") <= 2


# -- operator 7 --------------------------------------------------------------------------------------------


def test_components_with_rules_over_thousands_of_edges(spark):
    """Random links, a hub that a third of all pages point to, chains, and rules; against union-find in plain Python."""
    draw = random.Random(7)
    hosts = [f"{a}{k}.{tld}" for k in range(300) for a in "xy" for tld in ("com", "net", "org")]
    pages = [(k, f"http://{draw.choice(hosts)}/{draw.choice(['en', 'es', 'q'])}/{k}") for k in range(3_000)]
    edges = [(pages[draw.randrange(3_000)][1], pages[draw.randrange(3_000)][1]) for _ in range(900)]
    edges += [(u, "http://hub.org/") for _, u in pages[:1_000]] + [(pages[1_000 + k][1], pages[1_001 + k][1]) for k in range(200)]
    edges += edges[:50] + [(None, "http://a.b/"), ("http://a.b/", None)]
    rules = [("x1.com", "/", "allow"), ("net", "/es/", "block"), ("y2.org", "/en/", "block"), ("x3.org", "/", "allow"), ("com", "/q/", "block")]

    def parts(url):
        host, _, path = url.split("://")[1].partition("/")
        return host, "/" + path

    def own(host, path):
        fits = [(len(h + p), a == "allow", a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2] if fits else None

    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u and v:
            a, b = find("".join(parts(u))), find("".join(parts(v)))
            parent[max(a, b)] = min(a, b)
    said = defaultdict(set)
    for node in list(parent):
        host, _, path = node.partition("/")
        said[find(node)].add(own(host, "/" + path))
    frame = spark.createDataFrame([(*p, None) for p in pages], "page_id LONG, url STRING, html STRING")
    found = url_filter.judge(frame, spark.createDataFrame(rules, "host string, path string, action string"),
                             spark.createDataFrame(edges, "url string, target string")).collect()
    verdicts = Counter()
    assert len(found) == len(pages)
    for r in found:
        url = dict(pages)[r["page_id"]] if r["page_id"] == 0 else pages[r["page_id"]][1]
        host, path = parts(url)
        node = host + path
        group = said[find(node)] if node in parent else set()
        want = own(host, path) or ("allow" if "allow" in group else "block" if "block" in group else "allow")
        assert (r["verdict"], r["host"], r["path"]) == (want, host, path)
        if len(group) > 0:
            assert r["alias_root"] == find(node)
        verdicts[want] += 1
    assert min(verdicts.values()) > 100


# -- operator 8 --------------------------------------------------------------------------------------------


def test_ordinal_fit_is_the_likeliest():
    """No step in any weight or threshold makes the graded rows likelier."""
    draw = np.random.default_rng(8)
    true_w, limits = np.array([1.5, -1.0, 0.5]), np.array([0.0, 1.5])
    rows = []
    for _ in range(1_500):
        x = draw.normal(size=3)
        u = draw.random()
        below = 1 / (1 + np.exp(-(limits - true_w @ x)))
        rows.append(([0, 1, 2], x.tolist(), int((u > below).sum())))
    w, found = severity.fit_ordinal(rows, 3, 3, rounds=3_000)

    def loss(w, limits):
        x = np.array([r[1] for r in rows])
        below = np.hstack([np.zeros((len(rows), 1)), 1 / (1 + np.exp(-(limits[None] - (x @ w)[:, None]))), np.ones((len(rows), 1))])
        g = np.array([r[2] for r in rows])
        return -np.log(below[np.arange(len(rows)), g + 1] - below[np.arange(len(rows)), g]).mean() + 0.5e-4 * w @ w

    least = loss(w, found)
    for k in range(3):
        for d in (-0.03, 0.03):
            assert loss(w + d * np.eye(3)[k], found) >= least - 1e-6
    for k in range(2):
        for d in (-0.03, 0.03):
            assert loss(w, found + d * np.eye(2)[k]) >= least - 1e-6
    assert np.allclose(w, true_w, atol=0.2) and np.allclose(found, limits, atol=0.2)


# -- stated values and columns that clash ------------------------------------------------------------------


CLASHING = ["_of", "_lost", "_spans", "_n_words", "_items", "_mark", "_stays", "_id", "_text", "_d", "_keeper", "_row", "c0", "c1", "mark",
            "group", "key", "sig", "h", "window", "n_words", "score", "kept"]


@pytest.fixture(scope="module")
def clashing(spark):
    base = " ".join(words(2, 120))
    rows = [(1, base), (1, base), (2, base + " more words"), (3, None), (4, ""), (None, base), (6, " ".join(words(3, 90)))]
    schema = "doc_id LONG, text STRING, n_chars LONG, " + ", ".join(f"`{c}` STRING" for c in CLASHING)
    return spark.createDataFrame([(i, t, len(t or ""), *[f"{c} {i}" for c in CLASHING]) for i, t in rows], schema)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(words(3, 90)[10:40]))], "item_id LONG, text STRING")


@pytest.mark.parametrize("name", ["quality", "jaccard", "chunks", "decontaminate", "decontaminate by join"])
def test_stages_keep_clashing_columns(spark, clashing, bench, name):
    stage = {
        "quality": quality.keep_good, "jaccard": jaccard_join.keep_one, "chunks": chunks.cut_repeats,
        "decontaminate": lambda d: decontaminate.keep_clean(d, bench),
        "decontaminate by join": lambda d: decontaminate.keep_clean(d, bench, block_bytes=0),
    }[name]
    kept = stage(clashing)
    assert kept.columns == clashing.columns
    rows = kept.collect()
    for r in rows:
        assert all(r[c] == f"{c} {r['doc_id']}" for c in CLASHING)
    ids = sorted((r["doc_id"] for r in rows), key=str)
    assert ids == {
        "quality": ids, "jaccard": sorted([1, 3, 4, 6, None], key=str), "chunks": sorted([1, 1, 2, 3, 4, None, 6], key=str),
        "decontaminate": sorted([1, 1, 2, 3, 4, None], key=str), "decontaminate by join": sorted([1, 1, 2, 3, 4, None], key=str)}[name]
    with pytest.raises(ValueError, match="differ only by case"):
        stage(clashing.withColumnRenamed("kept", "Text"))


def test_reports_on_clashing_columns(clashing, bench):
    for found in (chunks.dedup(clashing), decontaminate.scan(clashing, bench), decontaminate.scan(clashing, bench, block_bytes=0)):
        assert len(set(found.columns)) == len(found.columns) and found.count() == 7
        assert {"_n_words", "_spans"} <= set(found.columns) and found.filter("doc_id = 3").first()["_n_words"] == 0


@pytest.mark.parametrize("text", [None, "", " \n\t "])
def test_stated_values_of_texts_without_words(spark, bench, text):
    docs = spark.createDataFrame([(5, text), (5, text)], "doc_id LONG, text STRING")
    train = spark.createDataFrame([("the cat sat", "en"), ("der Hut ist", "de")], "text STRING, lang STRING")
    labels = spark.createDataFrame([(5, 1, 1)], "doc_id LONG, quality INT, grade INT")
    tokenizer = bpe.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    pieces = token_counts.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))

    def both(df):
        rows = [r.asDict() for r in df.collect()]
        assert len(rows) == 2 and rows[0] == rows[1]
        return rows[0]

    r = both(quality.classify(docs))
    assert (r["score"], r["p_weak"], r["kept"]) == (0.0, 0.0, False)
    assert quality.keep_good(docs).count() == 0
    r = both(jaccard_join.join(docs))
    assert (r["n_shingles"], r["component_id"], r["n_links"]) == (0, 5, 0)
    r = both(language.identify(docs, language.fit(train)))
    assert (r["lang_pred"], r["score"], r["languages"]) == ("und", 0.0, {})
    r = both(chunks.dedup(docs))
    assert (r["text"], r["_spans"], r["_n_words"]) == (text, [], 0)
    r = both(decontaminate.report(docs, bench))
    assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (0, 0, 0, False)
    assert both(severity.grade(docs, severity.fit(docs, labels)))["eta"] == 0
    r = both(line_rules.judge(docs, line_rules.fit(docs, labels)))
    assert (r["n_words"], r["n_dup_lines"], r["base_failed"], r["kept"], r["content_share"]) == (0, 0, True, False, 0.0)
    if not text:
        assert both(bpe.encode_documents(docs, tokenizer))["ids"] == []
        assert both(token_counts.count_tokens(docs, pieces))["n_tokens"] == 0


def test_url_filter_on_awkward_pages(spark):
    schema = "page_id LONG, url STRING, html STRING, host STRING, node STRING, root STRING, verdict STRING"
    rules = spark.createDataFrame([("a.net", "/", "block")], "host string, path string, action string")
    assert url_filter.judge(spark.createDataFrame([], schema), rules).count() == 0
    long = "<link rel=canonical href='http://a.net/x'>" + "<p>canonical</p>" * 60_000
    rows = [(1, "http://b.org/", long), (1, "http://b.org/", long), (2, "http://b.org/", None), (3, None, None), (None, "http://a.net/", ""), (4, "", "refresh")]
    found = url_filter.judge(spark.createDataFrame([(*r, "h", "n", "r", "v") for r in rows], schema), rules).collect()
    assert sorted(((r["page_id"], r["host"], r["verdict"]) for r in found), key=str) == sorted([
        (1, "b.org", "block"), (1, "b.org", "block"), (2, "b.org", "block"), (3, "", "allow"), (None, "a.net", "block"), (4, "", "allow")], key=str)
    only = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")
    assert {r["verdict"] for r in url_filter.judge(only, rules.filter("host = 'x'")).collect()} == {"allow"}
