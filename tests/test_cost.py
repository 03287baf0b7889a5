"""That costly steps are taken once, and that the cheap tests in front of patterns change no result."""

import json
import random

from pyspark.sql import functions as F

from checks import payloads
from checks.queries import landing_files
from millrace.functions import text, words
from millrace.functions.patterns import captured, quoted, word_start
from millrace.sources import boards

LISTS = [words.RELEVANT_TITLE_WORDS, words.EXCLUDED_TITLE_WORDS, words.DETAIL_TITLE_WORDS, words.DETAIL_EXCLUDED_WORDS,
         words.FOREIGN_WORDS, words.RELEVANT_DESCRIPTION_WORDS, *[w for _, w in words.ROLE_WORDS + words.SENIORITY_WORDS]]


def _strings(terms, seed=5, n=600):
    """Terms put between all kinds of neighbours, letters of other scripts and combining marks included."""
    rng = random.Random(seed)
    marks = ["", " ", "x", "é", "я", "_", "7", "́", "²", ".", "-", "–", "‍", " ", "/", "ſ"]
    return ["".join(rng.choice(marks) + rng.choice(terms) + rng.choice(marks) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def test_word_patterns_share_first_characters_and_find_the_same(spark):
    assert all(words.bounded(found).startswith("(?U)(?=[") for found in LISTS)
    samples = _strings([w.replace("\\.?", ".").replace("\\s*", " ").split("(")[0] for found in LISTS for w in found])
    df = spark.createDataFrame([(s,) for s in samples], "t STRING")
    for found in LISTS:
        plain = r"(?U)\b(?:" + "|".join(found) + r")\b"
        differ = df.filter((F.col("t").rlike(plain) != F.col("t").rlike(words.bounded(found)))
                           | (F.regexp_count("t", F.lit(plain)) != F.regexp_count("t", F.lit(words.bounded(found)))))
        assert differ.count() == 0


def test_captured_terms_are_the_same_behind_the_cheap_tests(spark):
    terms = ["ai", "ml", "ml ops", "c", "c++", "9x", "_id"]
    assert word_start(terms) != r"\b" and word_start([*terms, "²x"]) == r"\b"
    df = spark.createDataFrame([(s,) for s in _strings(terms)], "t STRING")
    longest = "|".join(quoted(t) for t in sorted(terms, key=len, reverse=True))
    plain = F.regexp_extract_all("t", F.lit(rf"(?U)\b(?=({longest}))"), F.lit(1))
    assert df.filter(plain != captured(F.col("t"), word_start(terms), terms)).count() == 0


def test_pieces_lose_all_white_space_of_unicode(spark):
    every = "".join(chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000)
    spaces = spark.createDataFrame([(c,) for c in every], "c STRING").filter(F.col("c").rlike(r"(?U)^\s$")).collect()
    assert {r.c for r in spaces} == set(text.WHITE_SPACE)
    row = spark.createDataFrame([(f"<p>{text.WHITE_SPACE}a \n b{text.WHITE_SPACE}</p>x < y<br><!-- <b> -->{text.WHITE_SPACE}",)], "t STRING")
    assert row.select(text.clean_html(F.col("t"))).first()[0] == "a \n b x < y"


def test_rich_answers_are_read_once(spark, tmp_path):
    """The result is made from the answers as parsed, not from a second reading of them."""
    answer = json.dumps({"data": {"jobBoard": {"jobPostings": [{"id": "1", "title": "AI", "descriptionHtml": "<p>d</p>"}]}}})
    spark.createDataFrame([("A", "a", answer)], "company_name STRING, slug STRING, payload STRING").write.parquet(str(tmp_path / "answers"))
    rich = spark.read.parquet(str(tmp_path / "answers"))
    none = rich.limit(0)
    found = boards.ashby_with_fallback(rich, none, none)
    assert not any("/answers/" in f for f in found.inputFiles())
    assert [(r.external_id, r.description) for r in found.collect()] == [("1", "d")]


def test_answers_of_all_formats_come_from_one_reading_of_the_postings(spark, tmp_path):
    columns = ["slug", "ats_type", "external_id", "title", "location", "url", "description", "o_orderpriority", "salary_raw_meta",
               "pay", "t1"]
    rows = [(f"s{n % 4}", kind, str(n) if n < 6 else None, "t", "l", "u", "d", "1-URGENT", "m", "p", "x", n, n % 2, 1)
            for n, kind in enumerate(["greenhouse", "lever", "ashby", "workday"] * 2)]
    spark.createDataFrame(rows, ", ".join(f"{c} STRING" for c in columns) + ", o_orderkey LONG, place INT, wave INT").withColumn(
        "posted_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "postings"))
    answers = payloads.boards(spark.read.parquet(str(tmp_path / "postings")))
    assert answers._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    got = {r.slug: json.loads(r.payload) for r in answers.collect()}
    assert set(got) == {"s0", "s1", "s2"}
    assert [j["id"] for j in got["s0"]["jobs"]] == [0, 4] and [j["id"] for j in got["s1"]] == ["1", "5"]
    assert [j["id"] for j in got["s2"]["data"]["jobBoard"]["jobPostings"]] == ["2"]


def test_landed_files_grow_with_the_orders():
    assert landing_files(0) == landing_files(150_000) == 4 and landing_files(54_000_000) == 216
