"""Registered queries: each takes (spark, folder of the given tables) and gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import payloads
from checks.views import view
from millrace.functions import pay, places, text, titles, words
from millrace.operators import matching, merging
from millrace.operators import places as places_join
from millrace.operators.enrich import enrich_postings
from millrace.operators.filters import JobFilter, apply_filters
from millrace.plans import (behaviour, concentration, demand, experiments, landing, ranking, refresh, series,
                            similarity, trends)
from millrace.schemas import JOB_KEY
from millrace.session import explode_once, read_table, shared_dir, spread
from millrace.sinks import tables as sinks
from millrace.sinks.changes import ChangeTable
from millrace.sources import boards, registry, seed
from millrace.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = date(2024, 2, 10)
DISPLAY_AS_OF = "2024-01-31 00:00:00"


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, root: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, root)

    QUERIES[fn.__name__] = run
    return run


def _demand(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return view(spark, root, "jobs"), view(spark, root, "job_skills"), view(spark, root, "skills")


def _trend(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, root, "skill_snapshots"), view(spark, root, "skills")


def _text_dates(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def _joined(skills: str = "skills") -> Column:
    return F.array_join(F.transform(skills, lambda s: F.concat(s["skill"], F.lit(":"), s["category"])), "|")


# -- filters -----------------------------------------------------------------------------------------------

MIN_SALARY = JobFilter(min_salary=150_000)
PLACES = JobFilter(locations=["Remote", "Seattle", "Boston"])
COMPANIES = JobFilter(companies=[f"Customer#{n:09d}" for n in (1, 5, 7, 10, 22, 40, 64, 100)])
ROLES = JobFilter(role_categories=["ML Engineer", "Data Engineer"])
SKILL = JobFilter(skill="A_s")
ALL_PARTS = JobFilter(
    min_salary=120_000, locations=["Remote", "Austin", "Miami", "Phoenix"],
    role_categories=["ML Engineer", "Clinical AI", "AI / ML"], skill="rag",
)


def _filter_query(name: str, flt: JobFilter) -> None:
    def run(spark: SparkSession, root: str) -> DataFrame:
        jobs, links, _ = _demand(spark, root)
        return apply_filters(jobs, links, flt).select(
            *JOB_KEY, "company_name", "location_normalized", "role_category", "salary_min", "salary_max"
        )

    run.__name__ = name
    query(run)


for _name, _flt in {
    "filter_min_salary": MIN_SALARY, "filter_locations": PLACES, "filter_companies": COMPANIES,
    "filter_roles": ROLES, "filter_skill": SKILL, "filter_all_parts": ALL_PARTS,
}.items():
    _filter_query(_name, _flt)


@query
def filter_skill_search(spark: SparkSession, root: str) -> DataFrame:
    """A search text takes the place of the skill part; the literal variant."""
    jobs, links, _ = _demand(spark, root)
    flt = JobFilter(skill="spark", skill_is_pattern=False).searching("c++")
    return apply_filters(jobs, links, flt).select(*JOB_KEY)


@query
def filtered_jobs(spark: SparkSession, root: str) -> DataFrame:
    jobs, links, skills = _demand(spark, root)
    found = demand.jobs_with_skills(jobs, links, skills, MIN_SALARY)
    return found.select(*JOB_KEY, "company_name", "salary_min", _joined().alias("skills"))


@query
def newest_jobs(spark: SparkSession, root: str) -> DataFrame:
    """The feed: newest first, the first fifty, seven skills each."""
    jobs, links, skills = _demand(spark, root)
    feed = _text_dates(demand.job_feed(jobs, links, skills, ROLES), "fetched_at")
    return feed.select(*JOB_KEY, "fetched_at", F.array_join("shown", ", ").alias("shown"), "skill_count")


@query
def saved_jobs(spark: SparkSession, root: str) -> DataFrame:
    jobs, links, skills = _demand(spark, root)
    saved = demand.saved_jobs(view(spark, root, "saved_jobs"), jobs, links, skills)
    return _text_dates(saved, "saved_at").select(*JOB_KEY, "notes", "saved_at", "is_active", _joined().alias("skills"))


# -- demand ------------------------------------------------------------------------------------------------


@query
def skill_frequency(spark: SparkSession, root: str) -> DataFrame:
    return demand.skill_frequency(*_demand(spark, root))


@query
def skill_frequency_filtered(spark: SparkSession, root: str) -> DataFrame:
    return demand.skill_frequency(*_demand(spark, root), ALL_PARTS, 25)


@query
def skill_frequency_by_category(spark: SparkSession, root: str) -> DataFrame:
    return demand.skill_frequency_by_category(*_demand(spark, root))


@query
def top_paying_skills(spark: SparkSession, root: str) -> DataFrame:
    return demand.top_paying_skills(*_demand(spark, root))


@query
def top_paying_skills_filtered(spark: SparkSession, root: str) -> DataFrame:
    return demand.top_paying_skills(*_demand(spark, root), PLACES, top_n=60, min_jobs=3)


@query
def skill_combinations(spark: SparkSession, root: str) -> DataFrame:
    jobs, links, _ = _demand(spark, root)
    pairs = demand.skill_combinations(jobs, links)
    return pairs.withColumn("label", text.pair_label(F.col("skill_a"), F.col("skill_b")))


@query
def study_roadmap(spark: SparkSession, root: str) -> DataFrame:
    roadmap = demand.study_roadmap(*_demand(spark, root))
    return roadmap.withColumn("skills", F.array_join("skills", "|"))


@query
def study_roadmap_for_role(spark: SparkSession, root: str) -> DataFrame:
    roadmap = demand.study_roadmap(*_demand(spark, root), "Data Engineer", 25)
    return roadmap.withColumn("skills", F.array_join("skills", "|"))


@query
def skills_summary_stats(spark: SparkSession, root: str) -> DataFrame:
    jobs, links, _ = _demand(spark, root)
    return demand.skills_summary_stats(jobs, links, ROLES)


@query
def top_stack(spark: SparkSession, root: str) -> DataFrame:
    return demand.top_stack(*_demand(spark, root))


@query
def category_skill_rollup(spark: SparkSession, root: str) -> DataFrame:
    return demand.category_skill_rollup(demand.skill_frequency(*_demand(spark, root)))


@query
def last_updated(spark: SparkSession, root: str) -> DataFrame:
    latest = demand.last_updated(view(spark, root, "jobs"))
    return latest.select(text.last_updated_label(F.col("last_updated")).alias("last_updated"))


@query
def skill_export_order(spark: SparkSession, root: str) -> DataFrame:
    jobs, links, _ = _demand(spark, root)
    return demand.export_order(jobs, links, PLACES)


@query
def job_skill_matrix(spark: SparkSession, root: str) -> DataFrame:
    jobs, links, skills = _demand(spark, root)
    every_skill = [entry[2] for entry in seed.starter_entries()]
    return sinks.job_skill_matrix(jobs, links, skills, PLACES, every_skill)


@query
def matrix_column_order(spark: SparkSession, root: str) -> DataFrame:
    """K3: the matrix in its own column order, the most named skill first; how often each column holds a 1."""
    jobs, links, skills = _demand(spark, root)
    matrix = sinks.job_skill_matrix(jobs, links, skills, PLACES)
    named = matrix.columns[10:]
    counts = matrix.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(named)])
    rows = [F.struct(F.lit(k + 1).alias("place"), F.lit(c).alias("skill"), F.col(f"n{k}").alias("jobs")) for k, c in enumerate(named)]
    return counts.select(F.inline(F.array(*rows)))


@query
def company_names(spark: SparkSession, root: str) -> DataFrame:
    return demand.companies_list(view(spark, root, "jobs"))


@query
def job_cards(spark: SparkSession, root: str) -> DataFrame:
    """Display columns of every job."""
    jobs = view(spark, root, "jobs")
    low, high = F.col("salary_min"), F.col("salary_max")
    return jobs.select(
        *JOB_KEY,
        text.initial(F.col("company_name")).alias("initial"),
        pay.format_salary(low, high).alias("salary"),
        pay.format_salary(low, high, dash="–", missing="").alias("salary_short"),
        pay.meets_salary_threshold(low, high).alias("meets_threshold"),
        pay.salary_midpoint(low, high).alias("midpoint"),
        F.when(F.col("is_remote"), "Yes").otherwise("No").alias("remote"),
        F.date_format("posted_at", "yyyy-MM-dd").alias("posted"),
    )


@query
def frequency_csv(spark: SparkSession, root: str) -> DataFrame:
    """K1: the frequency table through its CSV export."""
    path = shared_dir(spark, "frequency-csv")
    sinks.write_csv(demand.skill_frequency(*_demand(spark, root), None, 200), path)
    return spark.read.schema("skill STRING, category STRING, job_count BIGINT, pct DOUBLE").option(
        "header", True
    ).csv(path)


# -- trends ------------------------------------------------------------------------------------------------


@query
def skill_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return _text_dates(trends.take_snapshot(view(spark, root, "job_skills"), AS_OF), "snapshot_date")


@query
def skill_trend(spark: SparkSession, root: str) -> DataFrame:
    trend = trends.skill_trend(*_trend(spark, root), AS_OF, 30)
    return _text_dates(trends.trend_order(trend), "snapshot_date")


@query
def fastest_growing_skills(spark: SparkSession, root: str) -> DataFrame:
    return trends.fastest_growing_skills(*_trend(spark, root), AS_OF, 60)


@query
def fastest_growing_recent(spark: SparkSession, root: str) -> DataFrame:
    return trends.fastest_growing_skills(*_trend(spark, root), AS_OF, 20, 40)


@query
def weekly_snapshot_summary(spark: SparkSession, root: str) -> DataFrame:
    return trends.weekly_snapshot_summary(*_trend(spark, root), AS_OF)


@query
def category_trend(spark: SparkSession, root: str) -> DataFrame:
    return _text_dates(trends.category_trend(*_trend(spark, root), AS_OF), "snapshot_date")


@query
def snapshot_pivot(spark: SparkSession, root: str) -> DataFrame:
    return trends.snapshot_pivot(*_trend(spark, root), AS_OF, 30)


@query
def top_skills_over_time(spark: SparkSession, root: str) -> DataFrame:
    return _text_dates(trends.top_skills_over_time(*_trend(spark, root), AS_OF, 30), "snapshot_date")


@query
def snapshot_span(spark: SparkSession, root: str) -> DataFrame:
    span = trends.has_trend(trends.snapshot_span(view(spark, root, "skill_snapshots"), AS_OF, 30))
    return _text_dates(span, "first_date", "last_date")


@query
def trends_csv(spark: SparkSession, root: str) -> DataFrame:
    """K2: the pivot through its CSV export."""
    path = shared_dir(spark, "trends-csv")
    pivot = trends.snapshot_pivot(*_trend(spark, root), AS_OF, 12)
    sinks.write_csv(pivot, path)
    return spark.read.schema(pivot.schema).option("header", True).csv(path)


@query
def snapshot_overwrite(spark: SparkSession, root: str) -> DataFrame:
    """M6: days taken a second time replace those days only."""
    path = shared_dir(spark, "snapshots")
    trends.write_snapshot(view(spark, root, "skill_snapshots"), path)
    again = read_table(spark, root, "events").filter(F.col("ts") >= "2024-01-20").groupBy(
        F.to_date("ts").alias("snapshot_date"), F.col("event_type").alias("canonical_name")
    ).agg(F.count(F.lit(1)).alias("job_count"))
    trends.write_snapshot(again, path)
    return _text_dates(spark.read.parquet(path), "snapshot_date")


# -- rules over texts --------------------------------------------------------------------------------------


def _postings(spark: SparkSession, root: str) -> DataFrame:
    return view(spark, root, "postings")


@query
def classify_role(spark: SparkSession, root: str) -> DataFrame:
    staged = _postings(spark, root).withColumn("_t", titles.role_text(F.col("title"), F.col("description")))
    return staged.select(*JOB_KEY, titles.classify_role_text(F.col("_t")).alias("role_category"))


@query
def classify_seniority(spark: SparkSession, root: str) -> DataFrame:
    return _postings(spark, root).select(*JOB_KEY, titles.classify_seniority(F.col("title")).alias("seniority"))


@query
def ai_role_filter(spark: SparkSession, root: str) -> DataFrame:
    title = F.col("title")
    return _postings(spark, root).select(
        *JOB_KEY,
        titles.title_excluded(title).alias("excluded"),
        titles.title_relevant(title).alias("title_relevant"),
        titles.is_ai_role(title, F.col("description")).alias("is_ai_role"),
        titles.title_looks_ai(title, words.WORKDAY_EXTRA_EXCLUDED_WORDS).alias("looks_ai"),
    )


@query
def normalize_location(spark: SparkSession, root: str) -> DataFrame:
    place = F.col("location")
    return _postings(spark, root).select(
        *JOB_KEY,
        places.normalize_location(place).alias("place"),
        places.is_us_location(place).alias("is_us"),
        places.posting_location(place, F.col("description")).alias("posting_place"),
    )


@query
def parse_salary(spark: SparkSession, root: str) -> DataFrame:
    parsed = pay.with_salary(_postings(spark, root).select(*JOB_KEY, "description"), F.col("description"))
    return parsed.drop("description")


@query
def enriched_postings(spark: SparkSession, root: str) -> DataFrame:
    return _text_dates(enrich_postings(_postings(spark, root)), "posted_at")


@query
def run_summary(spark: SparkSession, root: str) -> DataFrame:
    raw = _postings(spark, root)
    return refresh.run_summary(refresh.outcomes(raw, enrich_postings(raw), view(spark, root, "registry")))


@query
def clean_html(spark: SparkSession, root: str) -> DataFrame:
    pages = spread(read_table(spark, root, "pages"))
    return pages.select("page_id", text.clean_html(F.col("html")).alias("text"))


@query
def truncate_text(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents").select("doc_id", text.truncate(F.col("text")).alias("text"))


@query
def normalise_whitespace(spark: SparkSession, root: str) -> DataFrame:
    talk = spread(read_table(spark, root, "conversations"))
    return talk.select("conv_id", "turn", text.normalise_whitespace(F.col("text")).alias("text"))


@query
def time_ago(spark: SparkSession, root: str) -> DataFrame:
    as_of = F.lit(DISPLAY_AS_OF).cast("timestamp")
    return read_table(spark, root, "events").select("event_id", text.time_ago(F.col("ts"), as_of).alias("age"))


# -- dictionary matching -----------------------------------------------------------------------------------


@query
def extract_skills(spark: SparkSession, root: str) -> DataFrame:
    return matching.extract_skills(
        _postings(spark, root), JOB_KEY, "description", seed.starter_dictionary(spark), seed.broad_skills(spark)
    )


@query
def extract_skills_by_join(spark: SparkSession, root: str) -> DataFrame:
    """The same through the join that serves dictionaries of any size."""
    return matching.extract_skills(
        _postings(spark, root), JOB_KEY, "description", seed.starter_dictionary(spark), seed.broad_skills(spark),
        how="join",
    )


@query
def extract_skills_unsuppressed(spark: SparkSession, root: str) -> DataFrame:
    return matching.extract_skills(_postings(spark, root), JOB_KEY, "description", seed.starter_dictionary(spark))


def benchmark_terms(spark: SparkSession, root: str) -> DataFrame:
    """Three-word phrases and long words of the benchmark texts, as a dictionary."""
    lowered = F.lower("text")
    phrases = F.concat(
        F.regexp_extract_all(lowered, F.lit("([a-z]+ [a-z]+ [a-z]+)"), F.lit(1)),
        F.regexp_extract_all(lowered, F.lit("([a-z]{8,})"), F.lit(1)),
    )
    terms = read_table(spark, root, "benchmark").select(F.explode(phrases).alias("term")).distinct()
    return terms.withColumn("canonical", F.col("term"))


@query
def document_terms(spark: SparkSession, root: str) -> DataFrame:
    """Whole documents against a dictionary made from the benchmark texts."""
    documents = spread(read_table(spark, root, "documents").select("doc_id", "text"))
    found = matching.extract_skills(documents, ["doc_id"], "text", benchmark_terms(spark, root), how="join")
    return found.withColumnRenamed("canonical", "term")


@query
def dictionary_preparation(spark: SparkSession, root: str) -> DataFrame:
    """W5 at scale: parts as dictionary entries whose terms collide."""
    parts = read_table(spark, root, "part").select(
        F.col("p_name").alias("key"), F.array(F.upper("p_type"), F.col("p_brand")).alias("aliases"),
        F.col("p_brand").alias("canonical"), F.col("p_type").alias("category"), F.lit("").alias("subcategory"),
        F.col("p_partkey").alias("ord"),
    )
    return matching.prepare_dictionary(parts)


@query
def dictionary_skill_dimension(spark: SparkSession, root: str) -> DataFrame:
    prepared = dictionary_preparation(spark, root)
    return matching.dictionary_skills(prepared)


@query
def skill_categories(spark: SparkSession, root: str) -> DataFrame:
    return matching.skill_categories(dictionary_preparation(spark, root))


# -- sources -----------------------------------------------------------------------------------------------


def _normalised(df: DataFrame) -> DataFrame:
    return _text_dates(df, "posted_at")


@query
def normalise_greenhouse(spark: SparkSession, root: str) -> DataFrame:
    return _normalised(boards.normalise_greenhouse(payloads.greenhouse(_postings(spark, root))))


@query
def normalise_lever(spark: SparkSession, root: str) -> DataFrame:
    return _normalised(boards.normalise_lever(payloads.lever(_postings(spark, root))))


@query
def normalise_ashby(spark: SparkSession, root: str) -> DataFrame:
    return _normalised(boards.normalise_ashby(payloads.ashby(_postings(spark, root))))


@query
def normalise_ashby_fallback(spark: SparkSession, root: str) -> DataFrame:
    postings = _postings(spark, root)
    return _normalised(boards.ashby_with_fallback(
        payloads.ashby_rich_or_refused(postings), payloads.ashby_minimal(postings), payloads.ashby_details(postings)
    ))


@query
def normalise_workday(spark: SparkSession, root: str) -> DataFrame:
    postings = _postings(spark, root)
    return _normalised(
        boards.normalise_workday(payloads.workday_pages(postings), payloads.workday_details(postings))
    )


@query
def normalise_workday_pages(spark: SparkSession, root: str) -> DataFrame:
    """The same boards in list pages of up to four postings; no board is found incomplete."""
    postings = _postings(spark, root)
    pages = payloads.workday_full_pages(postings)
    complete = pages.join(boards.workday_incomplete(pages), ["slug", "board"], "left_anti")
    return _normalised(boards.normalise_workday(complete, payloads.workday_details(postings)))


@query
def workday_incomplete_boards(spark: SparkSession, root: str) -> DataFrame:
    """Pages of one posting each, of boards that report twelve postings."""
    orders = read_table(spark, root, "orders")
    pages = orders.select(
        F.concat(F.lit("c"), "o_custkey").alias("slug"), F.lit("c").alias("company_name"),
        F.lit("Careers").alias("board"),
        F.to_json(F.struct(
            F.lit(12).alias("total"), F.array(F.struct(F.lit("t").alias("title"))).alias("jobPostings")
        )).alias("payload"),
    )
    return boards.workday_incomplete(pages)


@query
def all_sources(spark: SparkSession, root: str) -> DataFrame:
    """Companies from the registry decide which normaliser reads their payloads."""
    postings = _postings(spark, root).drop("source", "company_name")
    landed = registry.with_company(postings, view(spark, root, "registry"))

    def of(source: str) -> DataFrame:
        return landed.filter(F.col("source") == source)

    raw = boards.union_postings(
        boards.normalise_greenhouse(payloads.greenhouse(of("greenhouse"))),
        boards.normalise_lever(payloads.lever(of("lever"))),
        boards.normalise_ashby(payloads.ashby(of("ashby"))),
        boards.normalise_workday(payloads.workday_pages(of("workday")), payloads.workday_details(of("workday"))),
    )
    return raw.groupBy("source", "company_name").agg(
        F.count(F.lit(1)).alias("postings"), F.countDistinct("title").alias("titles")
    )


@query
def registry_scan(spark: SparkSession, root: str) -> DataFrame:
    """The registry through its CSV file."""
    path = shared_dir(spark, "registry-csv")
    sinks.write_csv(view(spark, root, "registry"), path)
    return registry.read_registry(spark, path).select("name", "ats_type", "slug", F.coalesce("career_url", F.lit("")).alias("career_url"))


@query
def unknown_sources(spark: SparkSession, root: str) -> DataFrame:
    return registry.unknown_companies(view(spark, root, "registry"))


# -- merges ------------------------------------------------------------------------------------------------


def _changed(rows: DataFrame, keys: list[str], policy: dict[str, str], order: str) -> ChangeTable:
    """The rows as a stored table in the shared folder, which takes in batches as changes."""
    table = ChangeTable(shared_dir(rows.sparkSession, "changes"), rows.schema, tuple(keys), tuple(policy.items()), order)
    table.create(rows)
    return table


def _registry_part(spark: SparkSession, root: str, stored: bool) -> DataFrame:
    solvent = F.col("c_acctbal") > 0
    names = read_table(spark, root, "customer").filter(solvent if stored else ~solvent).select(F.col("c_name").alias("name"))
    return view(spark, root, "registry").join(names, "name").select(
        "name", "slug", "ats_type", "career_url", F.lit("1994-01-01").cast("timestamp").alias("created_at"))


def _company_batch(spark: SparkSession, root: str) -> DataFrame:
    """Companies that are not stored yet, and every order as a report about its company; a company may be reported any
    number of times."""
    first = _registry_part(spark, root, stored=False).withColumn("seq", F.lit(0).cast("long"))
    return first.unionByName(read_table(spark, root, "orders").select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"),
        F.concat(F.lit("c"), "o_custkey", F.lit("-"), "o_orderpriority").alias("slug"),
        F.col("o_orderstatus").alias("ats_type"),
        F.when(F.col("o_totalprice") < 300000, "").otherwise(
            F.concat(F.lit("https://careers.example.com/"), "o_orderkey")
        ).alias("career_url"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderkey").cast("long").alias("seq"),
    ))


@query
def merge_company(spark: SparkSession, root: str) -> DataFrame:
    stored = _registry_part(spark, root, stored=True)
    table = _changed(stored, ["name"], merging.COMPANY_POLICY, "reported TIMESTAMP, seq LONG")
    table.append(_company_batch(spark, root).withColumn("reported", F.col("created_at")), 0)
    return _text_dates(table.read(spark), "created_at")


def _job_batch(spark: SparkSession, root: str) -> DataFrame:
    """Every line item is a new record of its order's posting."""
    line = read_table(spark, root, "lineitem")
    key = F.col("l_orderkey")
    paid = F.col("l_returnflag") != "R"
    return line.select(
        key.cast("string").alias("external_id"),
        F.expr("CASE l_orderkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'workday' END")
        .alias("source"),
        F.concat(F.lit("Supplier#"), "l_suppkey").alias("company_name"),
        F.concat(F.lit("Line "), "l_linenumber", F.lit(" "), "l_linestatus").alias("title"),
        F.concat(F.lit("Dock "), "l_returnflag").alias("location"),
        F.lit("Remote").alias("location_normalized"),
        F.when(paid, F.floor("l_extendedprice").cast("int")).alias("salary_min"),
        F.when(paid, F.floor("l_extendedprice").cast("int") + 500).alias("salary_max"),
        F.lit(None).cast("string").alias("salary_raw"),
        F.lit(True).alias("is_remote"),
        F.concat(F.lit("u"), "l_partkey").alias("url"),
        F.lit(None).cast("string").alias("description"),
        F.lit("Data Engineer").alias("role_category"),
        F.lit("Senior").alias("seniority"),
        F.col("l_shipdate").alias("posted_at"),
        F.col("l_shipdate").alias("fetched_at"),
    )


def _merged_jobs(spark: SparkSession, root: str, times: int) -> DataFrame:
    """Stored are the jobs posted before 2000; the batch brings the others and a record for each line item."""
    jobs = view(spark, root, "jobs")
    later = jobs.filter(F.col("posted_at") >= "2000-01-01").drop("is_active")
    table = _changed(jobs.filter(F.col("posted_at") < "2000-01-01"), JOB_KEY, merging.JOB_POLICY, "fetched TIMESTAMP")
    batch = _job_batch(spark, root).unionByName(later).withColumns({"fetched": F.col("fetched_at"), "is_active": F.lit(True)})
    for number in range(times):
        table.append(batch, number)
        if number:
            table.fold(spark)
    return _text_dates(table.read(spark), "posted_at", "fetched_at").drop("salary_raw", "description", "is_remote")


@query
def merge_job(spark: SparkSession, root: str) -> DataFrame:
    return _merged_jobs(spark, root, 1)


@query
def merge_job_twice(spark: SparkSession, root: str) -> DataFrame:
    """The same batch again changes nothing, nor does a fold."""
    return _merged_jobs(spark, root, 2)


@query
def newest_record_per_key(spark: SparkSession, root: str) -> DataFrame:
    batch = _job_batch(spark, root).select(*JOB_KEY, "title", "url", "fetched_at")
    return _text_dates(merging.latest_per_key(batch, JOB_KEY, ["fetched_at"]), "fetched_at")


@query
def key_violations(spark: SparkSession, root: str) -> DataFrame:
    return merging.key_violations(_job_batch(spark, root), JOB_KEY)


@query
def merge_skill(spark: SparkSession, root: str) -> DataFrame:
    parts = read_table(spark, root, "part")
    current = parts.filter("p_size >= 49").groupBy(F.col("p_name").alias("canonical_name")).agg(
        F.lit("stored").alias("category"), F.lit("").alias("subcategory")
    )
    incoming = parts.select(
        F.col("p_name").alias("canonical_name"), F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"), F.col("p_partkey").alias("seq"),
    )
    kept = {"category": merging.KEEP, "subcategory": merging.KEEP}
    table = _changed(current, ["canonical_name"], kept, "seq LONG")
    table.append(incoming, 0)
    return table.read(spark)


def _more_links(spark: SparkSession, root: str) -> DataFrame:
    line = read_table(spark, root, "lineitem")
    return line.select(
        F.col("l_orderkey").cast("string").alias("external_id"),
        F.expr("CASE l_orderkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'workday' END")
        .alias("source"),
        F.concat(F.lit("Supplier skill "), F.col("l_suppkey") % 9).alias("canonical_name"),
    )


@query
def insert_or_ignore_links(spark: SparkSession, root: str) -> DataFrame:
    links = view(spark, root, "job_skills")
    table = _changed(links, [*JOB_KEY, "canonical_name"], {}, "seq LONG")
    table.append(_more_links(spark, root).unionByName(links), 0)
    return table.read(spark)


@query
def relink_jobs(spark: SparkSession, root: str) -> DataFrame:
    """Links of jobs in the batch are replaced, those of other jobs stay."""
    returned = read_table(spark, root, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").cast("string").alias("external_id")
    )
    batch = _more_links(spark, root).join(returned, "external_id", "left_semi")
    table = _changed(merging.links_by_job(view(spark, root, "job_skills")), JOB_KEY, merging.RELINK_POLICY, "seq LONG")
    table.append(merging.links_by_job(batch).withColumn("seq", F.lit(0).cast("long")), 0)
    return merging.links_of_jobs(table.read(spark))


@query
def save_job(spark: SparkSession, root: str) -> DataFrame:
    incoming = read_table(spark, root, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("external_id"),
        F.expr("CASE l_orderkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'workday' END")
        .alias("source"),
        F.concat(F.lit("quantity "), F.col("l_quantity").cast("int")).alias("notes"),
        F.col("l_shipdate").alias("saved_at"),
    )
    kept = {"notes": merging.KEEP, "saved_at": merging.KEEP}
    table = _changed(view(spark, root, "saved_jobs"), JOB_KEY, kept, "saved TIMESTAMP")
    table.append(incoming.withColumn("saved", F.col("saved_at")), 0)
    return _text_dates(table.read(spark), "saved_at")


@query
def quarantined_postings(spark: SparkSession, root: str) -> DataFrame:
    """Postings without a usable key: here those without a place stand for records without an id."""
    raw = _postings(spark, root).select("o_orderkey", "location", "source")
    return merging.split_keyed(raw, ["location", "source"])[1].select("o_orderkey", "location")


# -- refresh -----------------------------------------------------------------------------------------------


def _refreshed(spark: SparkSession, root: str) -> refresh.Refreshed:
    companies = spark.createDataFrame(
        [], "name STRING, slug STRING, ats_type STRING, career_url STRING, created_at TIMESTAMP"
    )
    current = refresh.Tables(
        companies, view(spark, root, "jobs").filter(F.col("posted_at") < "1998-01-01"),
        view(spark, root, "skills"), view(spark, root, "job_skills"),
    )
    return refresh.refresh(
        current, view(spark, root, "registry"), _postings(spark, root), seed.starter_dictionary(spark),
        seed.broad_skills(spark), F.lit("2002-01-01").cast("timestamp"), AS_OF,
    )


@query
def refresh_jobs(spark: SparkSession, root: str) -> DataFrame:
    jobs = _refreshed(spark, root).tables.jobs
    return _text_dates(jobs, "posted_at", "fetched_at").select(
        *JOB_KEY, "company_name", "title", "location", "location_normalized", "salary_min", "salary_max",
        "role_category", "seniority", "posted_at", "fetched_at", "is_active",
    )


@query
def refresh_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return _text_dates(_refreshed(spark, root).snapshot, "snapshot_date")


def _waves(spark: SparkSession, root: str) -> DataFrame:
    """Postings as boards report them: all in wave 1, every fifth a second time further down, and every third again in
    wave 2, under other titles, links and places. Boards without postings report too."""
    postings = _postings(spark, root).drop("source", "company_name")

    def report(wave: int, place: int, title: str, link: str, location: Column) -> Column:
        return F.struct(
            F.lit(wave).alias("wave"), F.lit(place).alias("place"), F.concat("title", F.lit(title)).alias("title"),
            F.concat("url", F.lit(link)).alias("url"), location.alias("location"))

    reports = F.array(
        report(1, 0, "", "", F.col("location")),
        F.when(F.expr("o_orderkey % 5 = 0"), report(1, 1, " Z", "/z", F.col("location"))),
        F.when(F.expr("o_orderkey % 3 = 0"), report(2, 0, " A", "/a", F.lit("Remote - US"))),
    )
    records = explode_once(postings, [c for c in postings.columns if c not in ("title", "url", "location")], reports, "r")
    records = records.select("*", "r.*").drop("r")
    boards_of = view(spark, root, "registry").select("slug", F.col("name").alias("company_name"), "ats_type")
    asked = boards_of.withColumn("wave", F.explode(F.array(F.lit(1), F.lit(2))))
    return asked.join(records, ["slug", "wave"], "left")


ORDERS_A_LANDING = 1_000_000  # orders whose answers land in four files


def landing_files(orders: int) -> int:
    """Files that grow with the answers, as each is written by one task; half of them are a batch."""
    return 4 * max(1, -(-orders // ORDERS_A_LANDING))


@query
def streamed_refresh(spark: SparkSession, root: str) -> DataFrame:
    """Landed files stream into the stored tables, one batch twice, with a fold in between."""
    folder = shared_dir(spark, "streamed")
    files = landing_files(read_table(spark, root, "orders").count())
    payloads.boards(_waves(spark, root)).repartition(files).write.json(f"{folder}/landed")
    stored = landing.StoredTables(f"{folder}/tables")
    stored.create(spark)
    handle = landing.batch_handler(
        stored, view(spark, root, "registry"), seed.starter_dictionary(spark), seed.broad_skills(spark),
        F.lit("2002-01-01").cast("timestamp"))

    def handle_and_repeat(batch: DataFrame, number: int) -> None:
        handle(batch, number)
        if number == 0:
            handle(batch, number)
            stored.fold(spark)

    ingest.for_each_batch(ingest.landed_lines(spark, f"{folder}/landed", files // 2), f"{folder}/progress", handle_and_repeat)
    links = stored.job_skills.read(spark).groupBy(*JOB_KEY).agg(
        F.array_join(F.array_sort(F.collect_list("canonical_name")), "|").alias("skills"))
    jobs = _text_dates(stored.jobs.read(spark), "posted_at", "fetched_at").drop("description")
    return jobs.join(links, JOB_KEY, "left").join(
        stored.companies.read(spark).select(F.col("name").alias("company_name"), "ats_type"), "company_name")


# -- streams -----------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    schema = read_table(spark, root, name).schema
    return spark.readStream.schema(schema).parquet(f"{root}/{name}.parquet*")


@query
def stream_daily_counts(spark: SparkSession, root: str) -> DataFrame:
    """Distinct users per day and event type, the newest days included."""
    out = shared_dir(spark, "daily")
    counted = ingest.daily_distinct(_stream(spark, root, "events"), "ts", "event_type", "user_id")
    ingest.write_updates(counted, f"{out}/table", f"{out}/progress")
    return _text_dates(ingest.current_counts(spark, f"{out}/table"), "snapshot_date")


@query
def stream_dedupe_postings(spark: SparkSession, root: str) -> DataFrame:
    """One record per key from a stream of line items; the lateness spans the table."""
    out = shared_dir(spark, "dedupe")
    records = _stream(spark, root, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("external_id"), F.col("l_returnflag").alias("source"),
        F.col("l_shipdate").alias("fetched_at"),
    )
    kept = ingest.dedupe_postings(records, "5000 days").select(*JOB_KEY)
    ingest.to_table(kept, f"{out}/table", f"{out}/progress")
    return spark.read.schema(kept.schema).parquet(f"{out}/table")


@query
def stream_ingest(spark: SparkSession, root: str) -> DataFrame:
    """Landed payload files, normalised as they arrive."""
    out = shared_dir(spark, "ingest")
    landed = payloads.greenhouse(_postings(spark, root))
    landed.write.json(f"{out}/landed")
    arriving = spark.readStream.schema(landed.schema).json(f"{out}/landed")
    raw = boards.normalise_greenhouse(arriving)
    ingest.to_table(raw, f"{out}/table", f"{out}/progress")
    return _normalised(spark.read.schema(raw.schema).parquet(f"{out}/table"))


# -- behaviour over time -----------------------------------------------------------------------------------

FUNNEL = ["view", "click", "signup", "purchase"]
FIRST_DAY, LAUNCH = "2024-01-01", "2024-01-16"


def _events(spark: SparkSession, root: str) -> DataFrame:
    """Events with the item they are about."""
    return read_table(spark, root, "events").withColumn("item", F.get_json_object("props", "$.k").cast("int"))


@query
def funnel_rates(spark: SparkSession, root: str) -> DataFrame:
    return behaviour.funnel(_events(spark, root), FUNNEL, "2 days")


@query
def funnel_entries(spark: SparkSession, root: str) -> DataFrame:
    """Users by the two-day spans in which they entered the funnel, and how far they got."""
    starts = behaviour.funnel_starts(_events(spark, root), FUNNEL, "2 days")
    return starts.groupBy("start", "steps_done").agg(F.count(F.lit(1)).alias("users"))


@query
def cohort_retention(spark: SparkSession, root: str) -> DataFrame:
    """By day of the first event: who comes back after how many days. Seventy days, so a bitmap has two words."""
    return _rounded(_text_dates(behaviour.retention(_events(spark, root), FIRST_DAY, 1, 70), "cohort"), "rate")


def _daily(spark: SparkSession, root: str) -> DataFrame:
    return series.daily_counts(_events(spark, root), F.col("item"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query
def daily_growth(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(_text_dates(series.growth(_daily(spark, root)), "day"), "growth")


@query
def trend_velocity(spark: SparkSession, root: str) -> DataFrame:
    rates = series.velocity(_daily(spark, root))
    return _rounded(_text_dates(rates, "day"), "recent_rate", "base_rate", "velocity")


@query
def count_spikes(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(_text_dates(series.spikes(_daily(spark, root), 14, 2.0), "day"), "median", "mad", "score")


# -- experiments -------------------------------------------------------------------------------------------


def _units(spark: SparkSession, root: str) -> DataFrame:
    """Users with what they brought before (x) and after (y) the launch, dealt to two variants."""
    after = F.col("ts") >= F.lit(LAUNCH).cast("timestamp")
    cents = F.round(F.col("value") * 100).cast("long")
    users = read_table(spark, root, "events").groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(~after, cents)), F.lit(0)).alias("x"), F.coalesce(F.sum(F.when(after, cents)), F.lit(0)).alias("y"))
    return experiments.assigned(users, ["control", "feed"], "launch")


@query
def experiment_readout(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(experiments.readout(_units(spark, root), "control"), "mean", "lift", "t", "df", "p")


@query
def experiment_bootstrap(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(experiments.bootstrap(_units(spark, root), "control"), "difference", "low", "high")


# -- recommendation ----------------------------------------------------------------------------------------


@query
def similar_items(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(similarity.similar_items(_events(spark, root), "item", "user_id", 0.42), "similarity")


@query
def ranking_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Items ranked by how often a user met them before the launch, against what they bought or clicked afterwards."""
    events = _events(spark, root)
    before = F.col("ts") < F.lit(LAUNCH).cast("timestamp")
    seen = events.filter(before).groupBy("user_id", "item").agg(F.count(F.lit(1)).alias("n"))
    gain = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 1)
    later = events.filter(~before).select(F.col("user_id").alias("user"), "item", gain.alias("gain"))
    ranked = ranking.top_ranked(seen, 20, "user_id", "item", "n")
    return _rounded(ranking.metrics(ranked, later, [5, 10, 20]), "precision", "recall", "map", "ndcg")


def _spent(spark: SparkSession, root: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    return read_table(spark, root, "events").groupBy("user_id").agg(F.sum(cents).alias("cents"))


@query
def concentration_curve(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(concentration.lorenz(_spent(spark, root), "cents", "user_id"), "share", "gini")


@query
def top_shares(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(concentration.shares_of_top(_spent(spark, root), "cents", "user_id", [0.01, 0.1, 0.5]), "share")


# -- large alias tables ------------------------------------------------------------------------------------


def _aliases(spark: SparkSession, root: str) -> DataFrame:
    """Words and pairs of words of the benchmark as aliases of places named by their first letters."""
    text = F.lower("text")
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in ("[a-z]{7,}", "[a-z]+ [a-z]{5,}", "[a-z]{2}[.,?]")])
    names = read_table(spark, root, "benchmark").select(F.explode(found).alias("alias")).distinct()
    place = F.concat(F.lit("place "), F.substring("alias", 1, 3))
    return names.select("alias", place.alias("canonical"), F.ascii(F.md5(place)) * 1000 + F.ascii("alias"))\
        .toDF("alias", "canonical", "ord")


@query
def alias_places(spark: SparkSession, root: str) -> DataFrame:
    turns = read_table(spark, root, "conversations")
    return places_join.places_by_join(turns, ["conv_id", "turn"], "text", _aliases(spark, root))
