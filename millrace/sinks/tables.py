"""Writers (K1-K3, K5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.filters import JobFilter
from millrace.plans.demand import export_order, jobs_with_skills
from millrace.schemas import JOB_KEY


def write_version(df: DataFrame, base: str, name: str, version: str) -> str:
    """K5: a merged table goes to a place of its own, as its input is still being read."""
    path = f"{base.rstrip('/')}/{name}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int) -> None:
    """K5 for tables that are joined again and again: `jobs` and `job_skills` written with the same number of
    buckets by job key are joined, and their skills gathered per job, without a shuffle."""
    (
        df.repartition(buckets, *JOB_KEY).write.mode("errorifexists").format("parquet")
        .bucketBy(buckets, *JOB_KEY).sortBy(*JOB_KEY).option("path", path).saveAsTable(table)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """K1/K2: CSV with a header; parts are written in parallel."""
    df.write.mode("overwrite").option("header", True).csv(path)


def matrix_skills(jobs: DataFrame, job_skills: DataFrame, flt: JobFilter | None = None) -> list[str]:
    """The matrix columns, most named skill first. A column per skill is part of the plan; where there are very many,
    `job_skill_pairs` says the same without a column each."""
    return [row["skill"] for row in export_order(jobs, job_skills, flt).collect()]


def job_skill_pairs(
    jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, flt: JobFilter | None = None
) -> DataFrame:
    """K3 in long form, for any number of skills: a row `(external_id, source, skill)` for each 1 of the matrix."""
    listed = jobs_with_skills(jobs, job_skills, skills, flt)
    return listed.select(*JOB_KEY, F.explode("skills").alias("s")).select(*JOB_KEY, F.col("s.skill").alias("skill"))


def job_skill_matrix(
    jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, flt: JobFilter | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """A row per job, ten fixed columns, then 1 or NULL for every skill.

    The skills of a job are one array already, so the matrix needs no pivot and no further shuffle.
    """
    columns = matrix_skills(jobs, job_skills, flt) if columns is None else columns
    names = F.transform("skills", lambda s: s["skill"])
    listed = jobs_with_skills(jobs, job_skills, skills, flt).withColumn("_names", names)
    return listed.select(
        F.coalesce("company_name", F.lit("")).alias("Company"),
        F.coalesce("title", F.lit("")).alias("Title"),
        F.coalesce("seniority", F.lit("")).alias("Seniority"),
        F.coalesce("role_category", F.lit("")).alias("Category"),
        F.coalesce(F.nullif("location_normalized", F.lit("")), "location", F.lit("")).alias("Location"),
        F.when(F.col("is_remote"), "Yes").otherwise("No").alias("Remote"),
        F.col("salary_min").alias("Salary Min"),
        F.col("salary_max").alias("Salary Max"),
        F.coalesce(F.date_format("posted_at", "yyyy-MM-dd"), F.lit("")).alias("Posted"),
        F.coalesce("url", F.lit("")).alias("URL"),
        *[F.when(F.array_contains("_names", skill), 1).alias(skill) for skill in columns],
    )
