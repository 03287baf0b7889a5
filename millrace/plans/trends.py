"""Snapshots and trends.

`snapshots` is `(snapshot_date, canonical_name, job_count)`, stored by date, so a window prunes partitions.
The day a window ends is always given.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import week_label

WEEKLY_DAYS = 90


def take_snapshot(job_skills: DataFrame, as_of: date) -> DataFrame:
    """Jobs per skill over all links, stamped with a day. Links are unique, so counting is enough."""
    return job_skills.groupBy("canonical_name").agg(F.count(F.lit(1)).alias("job_count")).select(
        F.lit(as_of).cast("date").alias("snapshot_date"), "canonical_name", "job_count"
    )


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """M6: replace the days present in `snapshot`, leave the others. A skill that is gone when a day is taken
    again leaves that day too."""
    snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(
        path
    )


def in_window(as_of: date, days: int) -> Column:
    """Both ends included; nothing bounds the window above."""
    return F.col("snapshot_date") >= F.date_sub(F.lit(as_of).cast("date"), days)


def skill_trend(snapshots: DataFrame, skills: DataFrame, as_of: date, days: int = 60) -> DataFrame:
    """J4 without its order; see `trend_order`."""
    return snapshots.filter(in_window(as_of, days)).join(
        skills.select("canonical_name", "category"), "canonical_name"
    ).select("snapshot_date", "canonical_name", "category", "job_count")


def trend_order(trend: DataFrame) -> DataFrame:
    """O4."""
    return trend.orderBy("snapshot_date", F.desc("job_count"), "canonical_name")


def fastest_growing_skills(
    snapshots: DataFrame, skills: DataFrame, as_of: date, days: int = 30, top_n: int = 15
) -> DataFrame:
    """Growth from the first to the last snapshot of the window.

    One pass: each skill keeps its first and last day with their counts, and counts where these are the first
    and last day of the whole window. A window with a single snapshot gives nothing.
    """
    day, count = F.col("snapshot_date"), F.col("job_count")
    ends = snapshots.filter(in_window(as_of, days)).groupBy("canonical_name").agg(
        F.min(F.struct(day, count)).alias("first"), F.max(F.struct(day, count)).alias("last")
    ).join(skills.select("canonical_name", "category"), "canonical_name")
    window = ends.agg(
        F.struct(F.min("first.snapshot_date").alias("start"), F.max("last.snapshot_date").alias("end")).alias("w")
    ).scalar()
    whole = (F.col("first.snapshot_date") == window["start"]) & (F.col("last.snapshot_date") == window["end"])
    growth = F.col("last.job_count") - F.col("first.job_count")
    return (
        ends.filter(whole & (F.col("first.snapshot_date") < F.col("last.snapshot_date")))
        .select(
            F.col("canonical_name").alias("skill"), "category", F.col("first.job_count").alias("count_start"),
            F.col("last.job_count").alias("count_end"), growth.alias("growth"),
        )
        .filter("growth > 0")
        .orderBy(F.desc("growth"), "skill")
        .limit(top_n)
    )


def weekly_snapshot_summary(snapshots: DataFrame, skills: DataFrame, as_of: date) -> DataFrame:
    """Daily counts summed by Monday-to-Sunday week."""
    trend = skill_trend(snapshots, skills, as_of, WEEKLY_DAYS)
    return trend.groupBy(week_label(F.col("snapshot_date")).alias("week"), "canonical_name", "category").agg(
        F.sum("job_count").alias("weekly_jobs")
    )


def category_trend(snapshots: DataFrame, skills: DataFrame, as_of: date, days: int = 60) -> DataFrame:
    """A11."""
    trend = skill_trend(snapshots, skills, as_of, days)
    return trend.groupBy("snapshot_date", "category").agg(F.sum("job_count").alias("total_jobs"))


def snapshot_dates(snapshots: DataFrame, as_of: date, days: int) -> list[date]:
    """The days of a window, for the pivot; there are at most as many as the window is long."""
    found = snapshots.filter(in_window(as_of, days)).select("snapshot_date").distinct().collect()
    return sorted(row["snapshot_date"] for row in found)


def snapshot_pivot(
    snapshots: DataFrame, skills: DataFrame, as_of: date, days: int = 60, dates: list[date] | None = None
) -> DataFrame:
    """A row per skill and a column per day (mean count, 0 where missing). Give `dates` to save the job
    that finds them."""
    dates = snapshot_dates(snapshots, as_of, days) if dates is None else dates
    trend = skill_trend(snapshots, skills, as_of, days).withColumn("day", F.col("snapshot_date").cast("string"))
    pivoted = trend.groupBy("canonical_name").pivot("day", [str(d) for d in dates]).agg(F.avg("job_count"))
    return pivoted.na.fill(0.0)


def top_skills_over_time(
    snapshots: DataFrame, skills: DataFrame, as_of: date, days: int = 60, top_n: int = 10
) -> DataFrame:
    """The trend of the skills with the highest single count; the broadcast side has `top_n` rows."""
    trend = skill_trend(snapshots, skills, as_of, days)
    best = trend.groupBy("canonical_name").agg(F.max("job_count").alias("best")).orderBy(
        F.desc("best"), "canonical_name"
    ).limit(top_n)
    return trend.join(F.broadcast(best.select("canonical_name")), "canonical_name", "left_semi").select(*trend.columns)


def snapshot_span(snapshots: DataFrame, as_of: date, days: int) -> DataFrame:
    """Number of days, first and last day of a window."""
    return snapshots.filter(in_window(as_of, days)).agg(
        F.countDistinct("snapshot_date").alias("dates"),
        F.min("snapshot_date").alias("first_date"),
        F.max("snapshot_date").alias("last_date"),
    )


def has_trend(span: DataFrame) -> DataFrame:
    """Keeps the span row only where there are two or more snapshots."""
    return span.filter("first_date < last_date")
