"""The corpus operators against brute force, the tokenizers library and the given labels, and on awkward tables."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

import corpus_pipeline
from checks.compare import connect, differences
from millrace.llm import (bpe, chunks, common, decontaminate, jaccard_join, language, line_rules, quality, severity,
                          token_counts, url_filter)
from millrace.llm.queries import ORACLES, QUERIES, URL_RULES

SMALL = "/root/testdata/sf0.001"
WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, sig STRING, digest STRING, score STRING"


def words(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n)]


def long_text():
    return " ".join(words(1, 30_000))


@pytest.fixture(scope="module")
def awkward(spark):
    """NULLs in every column, empty and long texts, ties, repeated rows, and columns that clash with inner names."""
    base = " ".join(words(2, 80))
    rows = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base, None, None, None), (3, None, "de", "a", 3),
            (4, "", "de", "a", 0), (5, " \n\t", "fr", "a", 3), (None, base, "en", "a", 1), (None, None, None, None, None),
            (6, long_text(), "en", "b", 9), (7, "Ünï ÇÖDE <|endoftext|> 'S\x1c日本 Σ İ", "fr", "b", 9), (8, "one two", "en", "b", 7)]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(words(2, 80)[5:30])), (2, "two"), (3, None), (None, "one"), (4, "--")],
                                 "item_id LONG, text STRING")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 1), (None, 1, 1), (3, None, None), (1, 1, 0)],
                                 "doc_id LONG, quality INT, toxic INT")


def operators(items, labels):
    graded = labels.withColumn("grade", F.col("toxic"))
    tokenizer = bpe.read_tokenizer(WORD_BPE)
    return {
        "quality": quality.classify, "tokens": lambda d: token_counts.count_tokens(d, token_counts.read_vocabulary(PIECES)),
        "jaccard": jaccard_join.join, "language": lambda d: language.identify(d, language.fit(d)), "chunks": chunks.dedup,
        "decontaminate": lambda d: decontaminate.report(d, items),
        "severity": lambda d: severity.grade(d, severity.fit(d, graded, grades=3)),
        "lines": lambda d: line_rules.judge(d, line_rules.fit(d, labels)),
        "bpe": lambda d: bpe.encode_documents(d, tokenizer),
    }


@pytest.mark.parametrize("name", ["quality", "tokens", "jaccard", "language", "chunks", "decontaminate", "severity",
                                  "lines", "bpe"])
def test_awkward_tables(awkward, empty, items, labels, name):
    run = operators(items, labels)[name]
    assert run(empty).count() == 0
    rows = run(awkward).collect()
    assert len(rows) == awkward.count()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in awkward.collect())
    same = [r.asDict() for r in rows if r["doc_id"] == 1]
    assert same[0] == same[1]


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    _, problems = differences(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name])
    assert not problems


def test_quality_follows_labels(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = QUERIES["op1_quality_classifier"](spark, SMALL).join(labels, "doc_id").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in found) >= 0.95 * len(found)


def test_quality_sample_of_null_and_repeated_ids(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality, "fit_scorer", lambda rows: sizes.append(len(rows)) or (None, 0.0))
    rows = [(None if k % 2 else 5, " ".join(words(k, 30))) for k in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    quality.fit(docs, train_rows=100)
    quality.fit(docs.limit(40).unionByName(docs.limit(40)), train_rows=100)
    assert 40 <= sizes[0] <= 300 and sizes[1] == 40


def test_token_counts_equal_a_unigram_tokenizer():
    pieces = token_counts.read_vocabulary(PIECES)
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    count = token_counts.counter(pieces)
    for text in ["a", "  two  spaces ", "línea\n\nnueva 日本語 🙂", "unbelievable tokenization", *(" ".join(words(k, 60)) for k in range(9))]:
        found = model.encode("▁" + text.replace(" ", "▁"))
        want = sum(len(t.encode()) if i == 0 else 1 for i, t in zip(found.ids, found.tokens))
        assert count(text)[0] == want


@pytest.mark.parametrize("shingle,num,den,parts,spare", [(5, 4, 5, 1, 0), (3, 9, 10, 3, 1), (3, 7, 10, 2, 1)])
def test_jaccard_join_is_exact(spark, shingle, num, den, parts, spare):
    draw, rows = random.Random(5), []
    for k in range(40):
        text = words(k % 8, 30 + 25 * (k % 8))
        for _ in range(draw.randint(0, 4)):
            text[draw.randrange(len(text))] = words(draw.random(), 1)[0]
        rows.append((k, " ".join(text)))
    rows += [(100, rows[0][1]), (101, "a b"), (102, "A B"), (103, "")]
    sets = {i: {tuple(w[k:k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if (w := t.lower().split()) else set()
            for i, t in rows}
    root = {i: i for i in sets}
    links = {i: set() for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            root = {i: min(root[a], root[b]) if r in (root[a], root[b]) else r for i, r in root.items()}
            if sets[a] != sets[b]:
                links[a].add(frozenset(sets[b]))
                links[b].add(frozenset(sets[a]))
    found = jaccard_join.join(spark.createDataFrame(rows, "doc_id LONG, text STRING"), shingle, num, den, parts=parts,
                              spare=spare).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == root
    assert {r["doc_id"]: r["n_links"] for r in found} == {i: len(s) for i, s in links.items()}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 51), (7, 7), (None, 3)], "u LONG, v LONG")
    found = {r["node"]: r["root"] for r in common.components(edges, "t").collect()}
    assert found == {**{k: 0 for k in range(21)}, 50: 50, 51: 50}


def test_languages_of_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = QUERIES["op4_language_mixture"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_mixed_text_has_two_languages(spark):
    one, two = " ".join("the of and with that this" for _ in range(60)), " ".join("der und nicht für über" for _ in range(60))
    train = spark.createDataFrame([(one, "en"), (two, "de")], "text STRING, lang STRING")
    docs = spark.createDataFrame([(1, one[:400] + " " + two[:900]), (2, one), (3, "123 !")], "doc_id LONG, text STRING")
    found = {r["doc_id"]: r for r in language.identify(docs, language.fit(train)).collect()}
    assert set(found[1]["languages"]) == {"en", "de"} and found[1]["lang_pred"] == "de"
    assert set(found[2]["languages"]) == {"en"} and found[3]["lang_pred"] == "und"


def test_passages_are_cut_despite_insertions(spark):
    passage = words(9, 60)
    rows = [(k, " ".join(words(100 + k, 40 + k) + passage + words(200 + k, 50))) for k in range(12)]
    clean = [(k, " ".join(words(300 + k, 200))) for k in range(20, 30)]
    found = {r["doc_id"]: r for r in chunks.dedup(spark.createDataFrame(rows + clean, "doc_id LONG, text STRING")).collect()}
    assert found[0]["text"] == rows[0][1] and all(found[k]["text"] == t for k, t in clean)
    for k, text in rows[1:]:
        cut = sum(len(text[s["start"]:s["end"]].split()) for s in found[k]["_spans"])
        assert 24 <= cut <= 62 and " ".join(passage) not in found[k]["text"]


def test_no_repeated_passage_is_missed():
    """Passages of 51 to 60 words in two contexts, of many and of few different words, long and short."""
    draw = random.Random(3)
    for turn in range(6_000):
        pool = words(turn, draw.choice((2, 3, 10, 60, 500))) if turn % 3 else list("abcdefghijk")[:draw.randint(1, 11)]
        passage = [draw.choice(pool) for _ in range(51 + turn % 10)]
        one, two = ([("%x" % draw.getrandbits(40)) if turn % 2 else draw.choice(pool) for _ in range(draw.randint(0, 40))]
                    for _ in range(2))
        here = [w.encode() for w in [*one, *passage, *two]]
        there = [w.encode() for w in [*two[::-1], *passage, *one[::-1]]]
        low, high = len(two), len(two) + len(passage)
        spans = chunks.repeated_spans(chunks.chunks(there), {d for _, _, d in chunks.chunks(here)}, chunks.PASSAGE_WORDS)
        assert max((min(b, high) - max(a, low) for a, b in spans), default=0) >= 24, (turn, passage)
        twice = chunks.repeated_spans(chunks.chunks(here + there), set(), chunks.PASSAGE_WORDS)
        low, high = low + len(here), high + len(here)
        assert max((min(b, high) - max(a, low) for a, b in twice), default=0) >= 24, (turn, passage)


def test_one_id_on_different_texts(spark):
    one, two, lone = words(41, 80), words(42, 80), words(43, 80)
    rows = [(1, one), (1, two), (2, [*one, "x"]), (3, [*two, "y"]), (3, lone), (3, lone), (0, [*two, "z"]), (4, []), (4, ["\n"])]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id LONG, text STRING")
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.join(docs).collect())
    assert found == sorted([(1, 76, 1, 1), (1, 76, 0, 2), (2, 77, 1, 1), (3, 77, 0, 2), (3, 76, 3, 0), (3, 76, 3, 0),
                            (0, 77, 0, 2), (4, 0, 4, 0), (4, 0, 4, 0)])
    kept = sorted((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs).collect())
    assert kept == sorted((k, " ".join(rows[i][1])) for k, i in ((1, 0), (3, 4), (0, 6), (4, 7), (4, 8)))


def test_decontamination_in_many_blocks(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate.report(docs, items).collect()))
    assert sorted(map(tuple, decontaminate.report(docs, items, block_bytes=60_000).collect())) == whole


def test_url_rules_and_aliases(spark):
    pages = spark.createDataFrame([
        (1, "http://a.net/es/1", '<LINK rel="canonical" href="http://b.org/x">'), (2, "https://b.org/x#top", ""),
        (3, "http://c.org/y", '<meta http-equiv="Refresh" content="0; url=//b.org/x">'), (4, "http://www.example.com/en/q", None),
        (5, "http://m.example.com/en/q?z", None), (6, None, None), (7, "no address", "canonical"),
        (8, "http://d.org/", "<link href='http://www.example.com/en/q' rel=canonical>"), (None, "http://A.NET/fr/", None),
        (9, "http://e.net/fr/2", "<link rel=canonical href='http://d.org/'>")],
        "page_id LONG, url STRING, html STRING")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    found = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert found == {
        1: ("a.net", "net/es/", "block"), 2: ("b.org", None, "block"), 3: ("c.org", None, "block"),
        4: ("www.example.com", "www.example.com/en/", "allow"), 5: ("m.example.com", "example.com/en/", "block"),
        6: ("", None, "allow"), 7: ("", None, "allow"), 8: ("d.org", None, "allow"), None: ("a.net", "net/fr/", "block"),
        9: ("e.net", "net/fr/", "block")}


def test_toxic_documents_are_graded(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.01").withColumnRenamed("toxic", "said").join(
        labels, "doc_id").collect()
    assert sum(r["said"] == (r["toxic"] == 1) for r in found) >= 0.95 * len(found)
    assert all(0 <= r["severity"] <= 2 for r in found)


def test_line_rules_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op9_line_quality"](spark, SMALL).collect():
        text = docs[r["doc_id"]]
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        triples = [tuple(found[k:k + 3]) for k in range(len(found) - 2)]
        times = {t: triples.count(t) for t in set(triples)} if len(triples) < 2_000 else None
        assert (r["n_words"], r["word_chars"]) == (len(found), sum(map(len, found)))
        assert (r["n_symbols"], r["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        if times is not None:
            hit = {k + j for k, t in enumerate(triples) if times[t] > 1 for j in range(3)}
            assert r["n_repeat_words"] == len(hit)
            assert r["base_failed"] == (len(found) < 50 or 100 * len(hit) > 50 * len(found))
        assert not (r["base_failed"] and r["kept"])


def test_viterbi_against_all_paths():
    draw = random.Random(3)
    for _ in range(50):
        e, m = [draw.uniform(-2, 2) for _ in range(6)], tuple(draw.uniform(-1, 1) for _ in range(4))

        def score(path):
            return sum(x * y for x, y in zip(e, path)) + sum(m[2 * a + b] for a, b in zip(path, path[1:]))

        paths = [[k >> j & 1 for j in range(6)] for k in range(64)]
        assert abs(score(line_rules.viterbi(e, m)) - max(map(score, paths))) < 1e-9


def test_bpe_equals_the_tokenizers_library(spark, awkward):
    library = Tokenizer.from_file(WORD_BPE)
    texts = {r["doc_id"]: r["text"] for r in awkward.filter("doc_id IS NOT NULL").collect()}
    texts |= {1000 + r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    tokenizer = bpe.read_tokenizer(WORD_BPE)
    encoded = bpe.encode_documents(spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING"), tokenizer)
    decoded = {r["doc_id"]: r["decoded"] for r in bpe.decode_documents(encoded, tokenizer).collect()}
    for r in encoded.collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        want = library.decode(ids, skip_special_tokens=False)
        assert r["decoded"] == want == decoded[r["doc_id"]]
        assert r["decoded_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_pipeline_stages(spark, awkward, empty):
    columns = awkward.columns
    for table in (awkward, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.staged(stage(spark, docs, SMALL), "t")
            assert docs.columns == columns, name
        assert stage is not None and corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_pipeline_keeps_clean_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    left = [r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert len(left) == len(set(left)) and len({docs[i] for i in left}) == len(left)
    assert not [i for i in left if labels.get(i) == 0]
    assert len(left) >= 0.6 * len(docs)
