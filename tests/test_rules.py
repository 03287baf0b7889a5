"""Title, place and pay rules (F1-F7, P1-P6, P15) and display text (F9-F19) on examples of our own."""

from datetime import datetime

from conftest import column
from pyspark.sql import functions as F

from millrace.functions import pay, places, text, titles


def _titles(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id INT, title STRING, d STRING")


def test_role_takes_first_list_in_order(spark):
    df = _titles(spark, [
        ("Data Engineer, LLM tooling", ""),
        ("Engineer", "You will own our ETL and Spark jobs."),
        ("Machine Learning Engineer", "no more"),
        ("Gardener", "roses"),
        ("Engineer", "x" * 2000 + " llm"),
        (None, None),
    ])
    got = column(df.select("id", titles.classify_role(F.col("title"), F.col("d")).alias("r")))
    assert got == ["LLM / Generative AI", "Data Engineer", "ML Engineer", "AI / ML", "AI / ML", "AI / ML"]


def test_role_words_need_boundaries(spark):
    df = _titles(spark, [("Partner", ""), ("NER engineer", ""), ("Allmighty", "")])
    got = column(df.select("id", titles.classify_role(F.col("title"), F.col("d")).alias("r")))
    assert got == ["AI / ML", "NLP Engineer", "AI / ML"]


def test_seniority(texts):
    df = texts("VP of Data", "Staff Engineer", "Staff Analyst", "Tech Lead", "Sr. Engineer", "Engineer II",
               "Jr. Analyst", "Engineer", "Entry-level Engineer", "Senior Director", "Senior Staff Designer")
    got = column(df.select("id", titles.classify_seniority(F.col("t")).alias("r")))
    assert got == ["VP / Director", "Principal / Staff", "Mid-level", "Lead / Architect", "Senior", "Mid-level",
                   "Junior / Associate", "Mid-level", "Junior / Associate", "VP / Director", "Lead / Architect"]


def test_relevance(spark):
    df = _titles(spark, [
        ("ML Intern", ""),
        ("AI Engineer", ""),
        ("Engineer", "pytorch, nlp and mlops"),
        ("Engineer", "pytorch and nlp"),
        ("HR Partner, AI", ""),
        ("Engineer", "x" * 1500 + " pytorch nlp mlops"),
        ("Coxop model", ""),
        ("Co-op model", ""),
        ("Engineer", None),
    ])
    got = column(df.select("id", titles.is_ai_role(F.col("title"), F.col("d")).alias("r")))
    assert got == [False, True, True, False, False, False, False, False, False]


def test_light_title_check(texts):
    df = texts("Backend Engineer", "Nursing AI", "Data Analytics", "Painter", "Associate I, AI")
    assert column(df.select("id", titles.title_looks_ai(F.col("t")).alias("r"))) == [True, False, True, False, True]
    stricter = titles.title_looks_ai(F.col("t"), ["associate i"])
    assert column(df.select("id", stricter.alias("r"))) == [True, False, True, False, False]


def test_places(texts):
    df = texts("San Francisco, CA", " remote - US ", "Remote - Tier 1", "Remote – Tier 1", "Toronto or Remote",
               "transformers", "New York, NY", "Springfield", "", None, "Boston / Austin", "Remote -Mars", "NYC office",
               "International")
    got = column(df.select("id", places.normalize_location(F.col("t")).alias("r")))
    assert got == ["San Francisco", "Remote", None, "Remote", None, "San Francisco", "New York City", None, None, None,
                   "Boston", None, "New York City", "Remote"]
    flags = column(df.select("id", places.is_us_location(F.col("t")).alias("r")))
    assert flags == [g is not None for g in got]


def test_place_falls_back_to_description(spark):
    df = _titles(spark, [("Mars", "Our office is in Seattle."), ("Austin", "Seattle"), (None, "x" * 300 + "Seattle")])
    got = column(df.select("id", places.posting_location(F.col("title"), F.col("d")).alias("r")))
    assert got == ["Seattle", "Austin", None]


def test_own_alias_table(spark, texts):
    table = spark.createDataFrame(
        [("springfield", "Springfield", 1), ("spring", "Spring", 2), ("shelbyville", "Shelbyville", 3)],
        "alias STRING, canonical STRING, ord INT",
    )
    aliases = places.aliases_from_table(table)
    df = texts("Springfield", "springtime", "Shelbyville, spring")
    got = column(df.select("id", places.normalize_location(F.col("t"), aliases).alias("r")))
    assert got == ["Springfield", "Spring", "Spring"]


def test_alias_table_of_any_size(spark, texts):
    table = spark.range(12_000).selectExpr("concat('place', id, 'x') AS alias", "concat('P', id) AS canonical", "id AS ord")
    aliases = places.aliases_from_table(table)
    assert len(aliases) == 12_000


def _paid(texts, *values):
    df = pay.with_salary(texts(*values), F.col("t"))
    return [(r.salary_min, r.salary_max, r.salary_raw) for r in df.orderBy("id").collect()]


def test_salary_shapes(texts):
    got = _paid(
        texts, "from $120,000 to $180,000 a year", "$110k–$140k", "USD $95,500 - 105,500", "base salary of $133,000.",
        "Annual salary $101k", "total compensation of $210,000", "OTE $175k", "$160,000 per annum",
        "the salary range of 90000 to 120000", "$50 - $65 per hour", "$70/hr",
    )
    assert [g[:2] for g in got] == [
        (120000, 180000), (110000, 140000), (95500, 105500), (133000, 133000), (101000, 101000), (210000, 210000),
        (175000, 175000), (160000, 160000), (90000, 120000), (104000, 135200), (145600, 145600),
    ]
    assert got[1][2] == "$110k–$140k" and got[4][2] == "Annual salary $101k"


def test_salary_rejections_and_order(texts):
    got = _paid(
        texts, "great pay", "", None, "$20,000 - $30,000", "$180k - $120k, base pay $100,000", "$15 per hour",
        "$900 per hour; OTE $90k", "base salary of $90000", "$20/hr or $60,000 annually", "$100 - $500",
    )
    assert [g[:2] for g in got] == [
        (None, None), (None, None), (None, None), (None, None), (100000, 100000), (None, None), (90000, 90000),
        (900000, 900000), (60000, 60000), (100000, 500000),
    ]


def test_salary_spaces_may_be_unbreakable(texts):
    assert _paid(texts, "$120,000 – $150,000 ")[0] == (120000, 150000, "$120,000 – $150,000")


def test_threshold_and_format(spark):
    df = spark.createDataFrame(
        [(0, 150000, 150000), (1, 100000, 160000), (2, 100000, 140000), (3, None, None), (4, 120000, None),
         (5, 120000, 0), (6, 0, 0)], "id INT, a INT, b INT",
    )
    a, b = F.col("a"), F.col("b")
    assert column(df.select("id", pay.meets_salary_threshold(a, b).alias("r"))) == [
        True, True, False, False, False, False, False]
    assert column(df.select("id", pay.format_salary(a, b).alias("r"))) == [
        "$150,000", "$100,000 – $160,000", "$100,000 – $140,000", "Not listed", "$120,000", "$120,000", "Not listed"]
    assert column(df.select("id", pay.format_salary(a, b, "–", "").alias("r")))[1:4] == [
        "$100,000–$160,000", "$100,000–$140,000", ""]
    assert column(df.select("id", pay.salary_midpoint(a, b).alias("r")))[:6] == [
        150000, 130000, 120000, None, 120000, 120000]


def test_clean_html(texts):
    df = texts(
        "<p>One&nbsp;two</p> <b> three </b>", None, "no markup", "a<!-- b -->c", "<style>p{}</style>x<script>y('</p>')</script>",
        "5 &lt; 6 &amp;&amp; 7 &gt; 6", "caf&eacute; &#8211; &#x1F600; &unknown; &", '<a title="x > y" href=\'q\'>link</a>',
        "a < b", "line\none<br/>two", "&AMP;amp; &copy 2020", "<ul><li>1</li><li></li><li>2</li></ul>", "",
    )
    assert column(df.select("id", text.clean_html(F.col("t")).alias("r"))) == [
        "One two three", "", "no markup", "a c", "x", "5 < 6 && 7 > 6", "café – 😀 &unknown; &", "link", "a < b",
        "line\none two", "&amp; © 2020", "1 2", "",
    ]
    kept = column(df.select("id", text.clean_html(F.col("t"), drop_script_style=False).alias("r")))
    assert kept[4].startswith("p{} x y('")


def test_truncate_and_whitespace(texts):
    df = texts("short", None, "word " * 100, "x" * 400, "a  b\n\tc  d ")
    cut = column(df.select("id", text.truncate(F.col("t")).alias("r")))
    assert cut[:2] == ["short", ""] and cut[2] == ("word " * 60).rsplit(" ", 1)[0] + "…" and cut[3] == "x" * 300 + "…"
    assert column(df.select("id", text.normalise_whitespace(F.col("t")).alias("r")))[4] == "a b c d"


def test_time_ago(spark):
    moments = ["2024-03-10 11:30:00", "2024-03-10 13:00:00", "2024-03-10 07:00:01", "2024-03-08 12:00:00",
               "2024-02-01 00:00:00", None]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(moments)], "id INT, t STRING")
    as_of = F.lit("2024-03-10 12:00:00").cast("timestamp")
    got = column(df.select("id", text.time_ago(F.col("t").cast("timestamp"), as_of).alias("r")))
    assert got == ["just now", "just now", "4h ago", "2d ago", "5w ago", ""]


def test_labels(spark):
    df = spark.createDataFrame([(0, datetime(2024, 3, 13, 15, 4))], "id INT, ts TIMESTAMP")
    row = df.select(
        text.week_label(F.col("ts")).alias("week"), text.last_updated_label(F.col("ts")).alias("at"),
        text.initial(F.lit("acme")).alias("i"), text.pair_label(F.lit("a"), F.lit("b")).alias("p"),
    ).first()
    assert tuple(row) == ("2024-03-11/2024-03-17", "Mar 13, 2024 03:04 PM", "A", "a + b")


def test_unescape_knows_every_standard_name(texts):
    import html
    from html.entities import html5

    given = [f"x&{name}y" for name in sorted(html5)] + [
        "we&apos;re", "&#146;", "&#x92;", "&#0;", "&#xD800;", "&#1114112;", "&lbrack;", "&ampx", "&nothing;", "&", "&#;", "a&b"]
    found = column(texts(*given).select("id", text.unescape(F.col("t")).alias("r")))
    assert found == [html.unescape(t) for t in given]
