"""Schemas of the tables and of the landed payloads."""

from __future__ import annotations

JOB_KEY = ["external_id", "source"]

# The landing sequence: the name of the landed answer (names sort in landing order) and the place in it.
LANDING = ["landed", "position"]
LANDING_ORDER = "landed STRING, position INT"

COMPANIES = "name STRING, slug STRING, ats_type STRING, career_url STRING, created_at TIMESTAMP"

RAW_POSTINGS = (
    "external_id STRING, source STRING, company_name STRING, title STRING, location STRING, url STRING, "
    "description STRING, posted_at TIMESTAMP, salary_raw_meta STRING"
)

JOBS = (
    "external_id STRING, source STRING, company_name STRING, title STRING, location STRING, "
    "location_normalized STRING, salary_min INT, salary_max INT, salary_raw STRING, is_remote BOOLEAN, "
    "url STRING, description STRING, role_category STRING, seniority STRING, posted_at TIMESTAMP, "
    "fetched_at TIMESTAMP, is_active BOOLEAN"
)

SKILL_DICTIONARY = "term STRING, canonical STRING, category STRING, subcategory STRING, ord INT"
SKILL_HIERARCHY = "parent STRING, child STRING"
LOCATION_ALIASES = "alias STRING, canonical STRING, ord INT"
REGISTRY = "name STRING, ats_type STRING, slug STRING, career_url STRING"
SKILLS = "canonical_name STRING, category STRING, subcategory STRING"
JOB_SKILLS = "external_id STRING, source STRING, canonical_name STRING"
SKILL_SNAPSHOTS = "snapshot_date DATE, canonical_name STRING, job_count BIGINT"
SAVED_JOBS = "external_id STRING, source STRING, notes STRING, saved_at TIMESTAMP"

RAW_POSTING_COLUMNS = [
    "external_id", "source", "company_name", "title", "location", "url", "description", "posted_at",
    "salary_raw_meta",
]

# Landed payloads, one per board response. ``value`` of a metadata item is mixed-type, so it is read as text.
GREENHOUSE_PAYLOAD = (
    "jobs ARRAY<STRUCT<id: STRING, title: STRING, location: STRUCT<name: STRING>, absolute_url: STRING, "
    "updated_at: STRING, content: STRING, metadata: ARRAY<STRUCT<name: STRING, value: STRING>>>>"
)

LEVER_PAYLOAD = (
    "ARRAY<STRUCT<id: STRING, text: STRING, categories: STRUCT<location: STRING>, applyUrl: STRING, "
    "hostedUrl: STRING, createdAt: BIGINT, description: STRING, additional: STRING, descriptionPlain: STRING, "
    "lists: ARRAY<STRUCT<content: STRING>>>>"
)

ASHBY_PAYLOAD = (
    "data STRUCT<jobBoard: STRUCT<jobPostings: ARRAY<STRUCT<id: STRING, title: STRING, isRemote: BOOLEAN, "
    "isListed: BOOLEAN, locationName: STRING, publishedDate: STRING, externalLink: STRING, "
    "descriptionHtml: STRING, compensationTierSummary: STRING>>>>, "
    "errors ARRAY<STRUCT<extensions: STRUCT<code: STRING>>>"
)

ASHBY_DETAIL = (
    "data STRUCT<jobPosting: STRUCT<id: STRING, descriptionHtml: STRING, publishedDate: STRING, "
    "compensationTierSummary: STRING>>"
)

WORKDAY_PAGE = (
    "total INT, jobPostings ARRAY<STRUCT<title: STRING, externalPath: STRING, locationsText: STRING, "
    "postedOn: STRING>>"
)

WORKDAY_DETAIL = (
    "jobPostingInfo STRUCT<jobPostingId: STRING, jobReqId: STRING, jobDescription: STRING, postedOn: STRING>"
)
