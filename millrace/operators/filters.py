"""Filters over stored jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.schemas import JOB_KEY


@dataclass(frozen=True)
class JobFilter:
    """Empty, zero or missing parts are switched off; the others must all hold."""

    min_salary: int | None = None
    locations: Sequence[str] = ()
    companies: Sequence[str] = ()
    role_categories: Sequence[str] = ()
    skill: str | None = None
    skill_is_pattern: bool = True

    def searching(self, skill: str | None) -> "JobFilter":
        """A search text, where given, takes the place of the skill part."""
        return replace(self, skill=skill) if skill else self


def active(jobs: DataFrame) -> DataFrame:
    """P8."""
    return jobs.filter("is_active")


def pays_at_least(amount: int) -> Column:
    """Either end reaches the amount; unknown pay does not."""
    return (F.col("salary_min") >= amount) | (F.col("salary_max") >= amount)


def skill_contains(text: str, is_pattern: bool = True) -> Column:
    """Case-blind substring of the skill name; `%` and `_` stay wildcards unless told otherwise."""
    name = F.lower("canonical_name")
    if not is_pattern:
        return name.contains(text.lower())
    return name.like("%" + text.lower().replace("\\", "\\\\") + "%")


def apply_filters(jobs: DataFrame, job_skills: DataFrame, flt: JobFilter | None = None) -> DataFrame:
    """All parts of the filter together, over active jobs."""
    flt = flt or JobFilter()
    kept = active(jobs)
    if flt.min_salary:
        kept = kept.filter(pays_at_least(flt.min_salary))
    for column, values in (
        ("location_normalized", flt.locations),
        ("company_name", flt.companies),
        ("role_category", flt.role_categories),
    ):
        if values:
            kept = kept.filter(F.col(column).isin(list(values)))
    if flt.skill:
        having = job_skills.filter(skill_contains(flt.skill, flt.skill_is_pattern)).select(*JOB_KEY)
        kept = kept.join(having, JOB_KEY, "left_semi")
    return kept
