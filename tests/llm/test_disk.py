"""What the corpus operators write to disk beside their result."""

import random
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import common, jaccard_join


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}


def test_what_was_shuffled_for_a_staged_table_goes_with_the_write(spark):
    counted = spark.range(1_000).selectExpr("id % 7 AS k").groupBy("k").count()
    before, setting = _shuffle_files(spark), spark.conf.get(common.CLEANED_UP)
    kept = common.staged(counted.repartition("count"), "test")
    assert not _shuffle_files(spark) - before and spark.conf.get(common.CLEANED_UP) == setting
    assert kept.agg(F.sum("count")).first()[0] == 1_000


def test_copies_alone_bring_no_signature_together(spark, monkeypatch):
    """Copies of a text lie in several tasks, and every signature of it comes several times."""
    draw, met = random.Random(2), {}
    texts = [" ".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=120)) for _ in range(20)]
    near = texts[0] + " and one more"
    rows = [(n, texts[n % 20]) for n in range(80)] + [(80, near)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4, "doc_id")

    def staged(df, purpose):
        out = common.staged(df, purpose)
        return met.setdefault(purpose, out) if purpose == "jaccard-met" else out

    monkeypatch.setattr(jaccard_join, "staged", staged)
    found = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.join(docs, 5, 4, 5).collect()}
    assert found == {n: (n % 20 if n < 80 else 0, int(n % 20 == 0 if n < 80 else 1)) for n in range(81)}
    assert met["jaccard-met"].select("key").distinct().count() == 2


def test_a_signature_takes_sixteen_bytes_and_meets_its_like(spark):
    draw = random.Random(4)
    words = "the quick brown fox jumps over the lazy dog and runs away from all of them".split()
    rows = [(n, " ".join(draw.choices(words, k=draw.randint(0, 30)))) for n in range(400)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id LONG, text STRING").repartition(3)
    packed = jaccard_join._signed_sets(docs, 2, 4, 5, 1, 0, np.empty(0, np.uint64), 7)
    assert packed.filter("octet_length(keys) <> octet_length(sigs)").count() == 0
    each = [(int(s), int(k)) for r in packed.collect()
            for s, k in zip(np.frombuffer(r.sigs, np.int64), np.frombuffer(r.keys, np.int64), strict=True)]
    members = defaultdict(set)
    for text in {t for _, t in rows}:
        features = common.shingle_hashes(jaccard_join.words_of(text.encode()), 2)
        for s in jaccard_join.signatures(features, jaccard_join.Bands(4, 5), 1, 0, np.empty(0, np.uint64)):
            members[int(s.astype(np.int64))].add(features.tobytes())
    found = defaultdict(set)
    for sig, key in each:
        found[sig].add(key)
    assert {s: len(k) for s, k in found.items()} == {s: len(m) for s, m in members.items()}
    met = [(r.sig, r.key) for r in jaccard_join._met(packed).collect()]
    assert sorted(met) == sorted((s, k) for s, keys in found.items() if len(keys) > 1 for k in keys)
    assert any(len(list(combinations(k, 2))) > 1 for k in found.values())
