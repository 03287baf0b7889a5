"""Skill demand over stored jobs.

Tables: `jobs` (key external_id, source), `job_skills` (external_id, source, canonical_name; unique) and `skills`
(canonical_name; unique). Ties are broken by name. Counting happens before the skill dimension is joined, so
only one row per skill meets it, and counts are combined before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import words
from millrace.functions.pay import salary_midpoint_doubled
from millrace.operators.filters import JobFilter, active, apply_filters
from millrace.schemas import JOB_KEY

CATEGORY_TOP = 10
CATEGORY_POOL = 200
STACK_POOL = 60


def _links(selected: DataFrame, job_skills: DataFrame, *columns: str) -> DataFrame:
    """One row per (selected job, skill), with the job columns asked for."""
    return selected.select(*JOB_KEY, *columns).join(job_skills, JOB_KEY)


def _with_category(df: DataFrame, skills: DataFrame) -> DataFrame:
    """The category of each `skill`, for frames with one row per skill."""
    names = skills.select(F.col("canonical_name").alias("skill"), "category")
    return df.join(names, "skill")


def jobs_with_skills(
    jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, flt: JobFilter | None = None
) -> DataFrame:
    """Filtered jobs with `skills`, a sorted array of `struct<skill, category>` (NULL without skills).

    The array of a job holds distinct skills, so its length is bounded by the skill table. Not ordered; see
    `newest_first`.
    """
    few = flt is not None and flt != JobFilter()
    return attach_skills(apply_filters(jobs, job_skills, flt), job_skills, skills, few)


def attach_skills(selected: DataFrame, job_skills: DataFrame, skills: DataFrame, few: bool = False) -> DataFrame:
    """Jobs with their `skills` array. Where `few` jobs are selected, the links of all others are dropped before
    they are grouped."""
    if few:
        job_skills = job_skills.join(selected.select(*JOB_KEY), JOB_KEY, "left_semi")
    named = job_skills.join(skills, "canonical_name").select(
        *JOB_KEY, F.struct(F.col("canonical_name").alias("skill"), "category").alias("s")
    )
    per_job = named.groupBy(*JOB_KEY).agg(F.array_sort(F.collect_set("s")).alias("skills"))
    return selected.join(per_job, JOB_KEY, "left")


def newest_first(jobs: DataFrame) -> DataFrame:
    """O3."""
    return jobs.orderBy(F.desc("fetched_at"), *JOB_KEY)


def saved_jobs(saved: DataFrame, jobs: DataFrame, job_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """Saved jobs, active or not, with notes and skills, newest saved first."""
    chosen = jobs.join(saved, JOB_KEY)
    links = job_skills.join(saved.select(*JOB_KEY), JOB_KEY, "left_semi")
    return attach_skills(chosen, links, skills).orderBy(F.desc("saved_at"), *JOB_KEY)


def job_feed(
    jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, flt: JobFilter | None = None,
    first: int = 50, shown_skills: int = 7,
) -> DataFrame:
    """The newest `first` jobs, each with its first few skills in `shown` and their full number."""
    newest = newest_first(apply_filters(jobs, job_skills, flt)).limit(first)
    names = F.transform("skills", lambda s: s["skill"])
    return attach_skills(newest, job_skills, skills, few=True).withColumns(
        {"shown": F.slice(names, 1, shown_skills), "skill_count": F.coalesce(F.size("skills"), F.lit(0))}
    )


def _counted(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("canonical_name").alias("skill")).agg(F.count(F.lit(1)).alias("job_count"))


def skill_frequency(
    jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, flt: JobFilter | None = None,
    top_n: int | None = 30,
) -> DataFrame:
    """A3/O1: the most named skills (None: all, unordered); `pct` is of all filtered jobs, with or without skills."""
    selected = apply_filters(jobs, job_skills, flt)
    total = selected.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = _with_category(_counted(_links(selected, job_skills)), skills)
    shares = counted.select(
        "skill", "category", "job_count", F.round(F.col("job_count") / total * 100, 1).alias("pct")
    )
    return shares if top_n is None else shares.orderBy(F.desc("job_count"), "skill").limit(top_n)


def skill_frequency_by_category(
    jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, flt: JobFilter | None = None,
    pool_size: int | None = CATEGORY_POOL,
) -> DataFrame:
    """The ten most named skills of each category, out of the `pool_size` most named (None: out of all)."""
    pool = skill_frequency(jobs, job_skills, skills, flt, pool_size)
    return _top_per_category(pool).filter(F.col("category_rank") <= CATEGORY_TOP)


def _top_per_category(freq: DataFrame) -> DataFrame:
    by_rank = Window.partitionBy("category").orderBy(F.desc("job_count"), "skill")
    return freq.withColumn("category_rank", F.row_number().over(by_rank))


def top_stack(
    jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, flt: JobFilter | None = None,
    quota: dict[str, int] | None = None, pool_size: int | None = STACK_POOL,
) -> DataFrame:
    """The first few skills of chosen categories, out of the `pool_size` most named (None: out of all)."""
    quota = words.STACK_QUOTA if quota is None else quota
    allowed = F.create_map(*[F.lit(x) for item in quota.items() for x in item])
    pool = skill_frequency(jobs, job_skills, skills, flt, pool_size)
    return _top_per_category(pool).filter(F.col("category_rank") <= F.try_element_at(allowed, F.col("category")))


BUCKET = 1024


def _holding_rank(counts: DataFrame, group: list[str], value: str, rank: Column) -> DataFrame:
    """Of each group's `(value, n)` rows, the one that holds the 0-based `rank` in ascending order."""
    running = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("n").over(running)
    return counts.withColumn("upto", upto).filter((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))


def top_paying_skills(
    jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, flt: JobFilter | None = None,
    top_n: int = 20, min_jobs: int = 2,
) -> DataFrame:
    """Skills by the upper median (element n//2 of the sorted values) of their jobs' pay.

    Exact without gathering a skill's salaries anywhere: they are counted by value, the counts are summed into
    ranges of `BUCKET` values, the range that holds the median is found, then the value inside it. Each sort
    sees at most the number of ranges or `BUCKET` rows of a skill, however many jobs name it.
    """
    paid = apply_filters(jobs, job_skills, flt).filter("salary_min IS NOT NULL").withColumn(
        "m2", salary_midpoint_doubled(F.col("salary_min"), F.col("salary_max"))
    )
    # The null checks repeat what is known, so that both uses of `by_value` read one and the same shuffle.
    by_value = (
        _links(paid, job_skills, "m2")
        .select(F.col("canonical_name").alias("skill"), "m2", F.floor(F.col("m2") / BUCKET).alias("bucket"))
        .filter("skill IS NOT NULL AND m2 IS NOT NULL AND bucket IS NOT NULL")
        .groupBy("skill", "bucket", "m2").agg(F.count(F.lit(1)).alias("n"))
    )
    by_range = by_value.groupBy("skill", "bucket").agg(F.sum("n").alias("n"))
    totals = by_range.withColumn("total", F.sum("n").over(Window.partitionBy("skill"))).filter(
        F.col("total") >= min_jobs
    )
    middle = F.floor(F.col("total") / 2)
    target = _holding_rank(totals, ["skill"], "bucket", middle).select(
        "skill", "bucket", "total", (middle - (F.col("upto") - F.col("n"))).alias("rank")
    )
    median = _holding_rank(by_value.join(target, ["skill", "bucket"]), ["skill"], "m2", F.col("rank"))
    result = median.select(
        "skill", (F.col("m2") / 2).cast("bigint").alias("median_salary"), F.col("total").alias("job_count")
    )
    return (
        _with_category(result, skills).select("skill", "category", "median_salary", "job_count")
        .orderBy(F.desc("median_salary"), "skill")
        .limit(top_n)
    )


def skill_combinations(
    jobs: DataFrame, job_skills: DataFrame, flt: JobFilter | None = None, top_n: int = 20, min_count: int = 2
) -> DataFrame:
    """Skills most often named together.

    A job's distinct skills come together as one sorted array (bounded by the skill table, duplicates merged
    before the shuffle); each is paired with those after it. Pairs are counted where they arise, so a task
    sends on one row per distinct pair, not per job.
    """
    selected = apply_filters(jobs, job_skills, flt)
    per_job = _links(selected, job_skills).groupBy(*JOB_KEY).agg(
        F.array_sort(F.collect_set("canonical_name")).alias("s")
    )
    firsts = per_job.filter(F.size("s") > 1).select(F.posexplode("s").alias("at", "skill_a"), "s")
    pairs = firsts.select(
        "skill_a", F.explode(F.slice("s", F.col("at") + 2, F.size("s"))).alias("skill_b")
    )
    return (
        pairs.groupBy("skill_a", "skill_b").agg(F.count(F.lit(1)).alias("co_count"))
        .filter(F.col("co_count") >= min_count)
        .orderBy(F.desc("co_count"), "skill_a", "skill_b")
        .limit(top_n)
    )


def study_roadmap(
    jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, role_category: str | None = None,
    top_n_skills: int = 40,
) -> DataFrame:
    """The top skills grouped by category, as `(cat_rank, category, skills)`.

    Preferred categories first, the others by their best skill. The arrays hold `top_n_skills` names at most.
    """
    flt = JobFilter(role_categories=[role_category]) if role_category else None
    freq = skill_frequency(jobs, job_skills, skills, flt, top_n_skills)
    order = (-F.col("job_count")).alias("order")
    grouped = freq.groupBy("category").agg(F.array_sort(F.collect_list(F.struct(order, "skill"))).alias("s"))
    preferred = F.nullif(F.array_position(F.lit(words.ROADMAP_ORDER), F.col("category")), F.lit(0))
    # Unlisted categories come after the listed ones, the one with the best first skill first.
    rest = F.struct(F.coalesce(preferred, F.lit(len(words.ROADMAP_ORDER) + 1)), F.element_at("s", 1))
    # At most `top_n_skills` rows remain here, so one task ranks them.
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(rest))
    return grouped.select(
        rank.alias("cat_rank"), "category", F.transform("s", lambda x: x["skill"]).alias("skills")
    ).orderBy("cat_rank")


def skills_summary_stats(jobs: DataFrame, job_skills: DataFrame, flt: JobFilter | None = None) -> DataFrame:
    """One row of headline figures."""
    selected = apply_filters(jobs, job_skills, flt)
    named = _links(selected, job_skills).agg(F.countDistinct("canonical_name").alias("n")).scalar()
    return selected.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.coalesce(F.avg(F.nullif("salary_min", F.lit(0))).cast("bigint"), F.lit(0)).alias("avg_salary"),
        F.countDistinct("company_name").alias("companies"),
    ).select("total_jobs", F.coalesce(named, F.lit(0)).alias("unique_skills"), "avg_salary", "companies")


def category_skill_rollup(freq: DataFrame) -> DataFrame:
    """Totals of a frequency table by category and skill, with subtotals."""
    return freq.rollup("category", "skill").agg(F.sum("job_count").alias("job_count"))


def last_updated(jobs: DataFrame) -> DataFrame:
    """A16."""
    return active(jobs).agg(F.max("fetched_at").alias("last_updated"))


def export_order(jobs: DataFrame, job_skills: DataFrame, flt: JobFilter | None = None) -> DataFrame:
    """Every skill of the filtered jobs, most named first."""
    counted = _counted(_links(apply_filters(jobs, job_skills, flt), job_skills))
    return counted.orderBy(F.desc("job_count"), "skill")


def companies_list(jobs: DataFrame) -> DataFrame:
    """Names for a selector."""
    return jobs.select("company_name").distinct().orderBy("company_name")


