"""Logical tables of the engine as views over the given tables.

Each view is one SELECT that Spark and DuckDB both understand, so both sides read the same rows. Names in braces
are the given tables. Every view reads its tables whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from millrace.session import read_table, spread
from millrace.sources.seed import starter_entries


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    def cell(v):
        return str(v) if isinstance(v, int) else sql_text(v)

    return "VALUES " + ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)


_ENTRIES = starter_entries()
_SKILL_ROWS = [(i, e[2], e[3], e[4]) for i, e in enumerate(_ENTRIES)]
_TERM_ROWS: list[tuple] = []
for _e in _ENTRIES:
    for _term in [_e[0], *_e[1]]:
        _TERM_ROWS.append((len(_TERM_ROWS), _term))
SKILL_COUNT, TERM_COUNT = len(_SKILL_ROWS), len(_TERM_ROWS)

SKILLS = f"""
SELECT canonical_name, category, subcategory
FROM ({_values(_SKILL_ROWS)}) AS s(ord, canonical_name, category, subcategory)
"""

_SOURCE = """CASE {key} % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'workday' END"""
_PLACE = """CASE o_custkey % 12 WHEN 0 THEN 'Remote' WHEN 1 THEN 'San Francisco' WHEN 2 THEN 'New York City'
  WHEN 3 THEN 'Seattle' WHEN 4 THEN 'Boston' WHEN 5 THEN 'Los Angeles' WHEN 6 THEN 'Austin' WHEN 7 THEN 'Chicago'
  WHEN 8 THEN 'Washington DC' WHEN 9 THEN 'Miami' WHEN 10 THEN 'San Diego' ELSE 'Phoenix' END"""
_COMPANY = "'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0')"

JOBS = f"""
SELECT CAST(o_orderkey AS STRING) AS external_id,
       {_SOURCE.format(key='o_orderkey')} AS source,
       {_COMPANY} AS company_name,
       'Engineer ' || o_orderpriority AS title,
       {_PLACE} AS location,
       {_PLACE} AS location_normalized,
       CASE WHEN o_totalprice >= 50000 THEN CAST(floor(o_totalprice) AS INT) END AS salary_min,
       CASE WHEN o_totalprice >= 50000 AND o_orderpriority <> '5-LOW'
            THEN CAST(floor(o_totalprice) AS INT) + 1000 * CAST(o_orderkey % 50 AS INT) END AS salary_max,
       CAST(NULL AS STRING) AS salary_raw,
       o_custkey % 12 = 0 AS is_remote,
       'https://jobs.example.com/' || CAST(o_orderkey AS STRING) AS url,
       CAST(NULL AS STRING) AS description,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'ML Engineer' WHEN '2-HIGH' THEN 'Data Scientist'
            WHEN '3-MEDIUM' THEN 'Data Engineer' WHEN '4-NOT SPECIFIED' THEN 'Clinical AI'
            ELSE 'AI / ML' END AS role_category,
       CASE o_orderkey % 3 WHEN 0 THEN 'Senior' WHEN 1 THEN 'Mid-level' ELSE 'Lead / Architect' END AS seniority,
       o_orderdate AS posted_at,
       o_orderdate AS fetched_at,
       o_orderstatus <> 'F' AS is_active
FROM {{orders}}
"""

JOB_SKILLS = f"""
SELECT CAST(k AS STRING) AS external_id, {_SOURCE.format(key='k')} AS source, canonical_name
FROM (SELECT DISTINCT l_orderkey AS k, CAST(l_partkey % (1 + (l_orderkey * 7 + l_linenumber) % {SKILL_COUNT}) AS INT) AS at
      FROM {{lineitem}}) l
JOIN ({_values(_SKILL_ROWS)}) AS s(ord, canonical_name, category, subcategory) ON s.ord = l.at
"""

SNAPSHOTS = f"""
SELECT snapshot_date, canonical_name, job_count
FROM (SELECT CAST(ts AS DATE) AS snapshot_date,
             CAST((user_id * 5 + length(event_type)) % {SKILL_COUNT} AS INT) AS at,
             COUNT(DISTINCT user_id) AS job_count
      FROM {{events}} GROUP BY 1, 2) e
JOIN ({_values(_SKILL_ROWS)}) AS s(ord, canonical_name, category, subcategory) ON s.ord = e.at
"""

SAVED_JOBS = f"""
SELECT CAST(o_orderkey AS STRING) AS external_id, {_SOURCE.format(key='o_orderkey')} AS source,
       'priority ' || o_orderpriority AS notes, o_orderdate AS saved_at
FROM {{orders}} WHERE o_totalprice >= 400000
"""

REGISTRY = """
SELECT c_name AS name, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'greenhouse' WHEN 'BUILDING' THEN 'lever'
         WHEN 'FURNITURE' THEN 'ashby' WHEN 'HOUSEHOLD' THEN 'workday' ELSE 'bulletin' END AS ats_type,
       'c' || CAST(c_custkey AS STRING) AS slug,
       CASE WHEN c_acctbal < 0 THEN '' ELSE 'https://careers.example.com/' || CAST(c_custkey AS STRING) END
         AS career_url
FROM {customer}
"""

_THOUSANDS = "CAST(CAST(floor({n} / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST({n} % 1000 AS STRING), 3, '0')"
_K = "CAST(CAST(floor({n} / 1000) AS BIGINT) AS STRING)"
_TERMS = f"({_values(_TERM_ROWS)})"

POSTINGS = f"""
SELECT external_id, source, company_name, title, location, url,
       'Join ' || company_name || ' and work with ' || t1 || ', ' || upper(t2) || ' or (' || t3 || ') on '
         || t4 || 'ish ' || t5 || '; ' || topic || ' ' || pay || ' ' || place || ' ' || t6 AS description,
       posted_at,
       CASE WHEN o_orderpriority = '1-URGENT' THEN pay END AS salary_raw_meta,
       slug, pay, o_orderkey, t1, o_orderpriority
FROM (
  SELECT CAST(o_orderkey AS STRING) AS external_id,
         {_SOURCE.format(key='o_orderkey')} AS source,
         {_COMPANY} AS company_name,
         'c' || CAST(o_custkey AS STRING) AS slug,
         CASE o_custkey % 11 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Staff ' WHEN 2 THEN 'Principal '
           WHEN 3 THEN 'Lead ' WHEN 4 THEN 'Director of ' WHEN 5 THEN 'Jr. ' WHEN 6 THEN 'Associate '
           WHEN 7 THEN 'Head of ' WHEN 8 THEN 'Sr ' WHEN 9 THEN 'Entry-level ' ELSE '' END
         || CASE o_orderkey % 17 WHEN 0 THEN 'Machine Learning Engineer' WHEN 1 THEN 'Software Engineer'
           WHEN 2 THEN 'Marketing Manager' WHEN 3 THEN 'Data Scientist' WHEN 4 THEN 'Research Scientist, LLM'
           WHEN 5 THEN 'Sales Executive' WHEN 6 THEN 'AI Platform Engineer' WHEN 7 THEN 'Backend Developer'
           WHEN 8 THEN 'Data Engineer' WHEN 9 THEN 'HR Partner' WHEN 10 THEN 'NLP Engineer'
           WHEN 11 THEN 'Computer Vision Engineer' WHEN 12 THEN 'Clinical AI Specialist'
           WHEN 13 THEN 'Customer Success Manager' WHEN 14 THEN 'Modeling Analyst' WHEN 15 THEN 'Analytics Intern'
           ELSE 'Product Designer' END
         || CASE o_custkey % 5 WHEN 0 THEN ' II' WHEN 1 THEN ', New Grad' ELSE '' END AS title,
         CASE (o_orderkey * 3 + o_custkey) % 19 WHEN 0 THEN 'San Francisco, CA' WHEN 1 THEN 'Remote - US'
           WHEN 2 THEN 'Remote - Canada' WHEN 3 THEN 'London, United Kingdom' WHEN 4 THEN '' WHEN 6 THEN 'Palo Alto'
           WHEN 7 THEN 'Austin, TX' WHEN 8 THEN 'BOSTON' WHEN 9 THEN 'Berlin' WHEN 10 THEN 'Chicago, IL'
           WHEN 11 THEN 'New York, NY' WHEN 12 THEN 'Remote – Tier 2' WHEN 13 THEN 'Remote - Tier 1'
           WHEN 14 THEN 'Nowhere' WHEN 15 THEN 'Mesa, AZ or remote' WHEN 16 THEN 'International'
           WHEN 17 THEN ' washington, DC ' WHEN 18 THEN 'Remote -us' END AS location,
         'https://jobs.example.com/' || CAST(o_orderkey AS STRING) AS url,
         o_orderdate AS posted_at,
         CASE o_orderkey % 4 WHEN 0 THEN 'Machine learning, PyTorch, transformer and deep learning experience.'
           WHEN 1 THEN 'Our data pipeline is large; inference matters.' WHEN 2 THEN 'We like NLP and MLOps.'
           ELSE 'Health records.' END AS topic,
         CASE o_custkey % 7 WHEN 0 THEN 'Based in Seattle.' WHEN 1 THEN 'Work from home.'
           WHEN 2 THEN 'Office in Toronto.' ELSE 'Ask us.' END AS place,
         CASE o_orderkey % 12
           WHEN 0 THEN 'Pay: $' || {_THOUSANDS.format(n='n')} || ' - $' || {_THOUSANDS.format(n='(n + 25000)')} || ' per year.'
           WHEN 1 THEN 'Base salary of $' || {_THOUSANDS.format(n='n')} || '.'
           WHEN 2 THEN 'OTE $' || {_K.format(n='n')} || 'k'
           WHEN 3 THEN '$' || CAST(20 + n % 90 AS STRING) || ' - $' || CAST(40 + n % 120 AS STRING) || ' per hour'
           WHEN 4 THEN 'The salary range of ' || CAST(n AS STRING) || ' to ' || CAST(n + 20000 AS STRING) || '.'
           WHEN 5 THEN '$' || {_THOUSANDS.format(n='n')} || ' annually'
           WHEN 6 THEN 'Total compensation of USD $' || {_THOUSANDS.format(n='n')}
           WHEN 7 THEN 'Competitive pay.'
           WHEN 8 THEN '$' || {_K.format(n='n')} || 'k–$' || {_K.format(n='(n + 30000)')} || 'k'
           WHEN 9 THEN '$' || CAST(n % 500 AS STRING) || '/hr'
           WHEN 10 THEN '$' || {_K.format(n='(n + 30000)')} || 'k to $' || {_K.format(n='n')} || 'k, base pay $' || CAST(n AS STRING)
           ELSE 'Range USD $' || CAST(n AS STRING) || ' to ' || CAST(n + 1000 AS STRING) END AS pay,
         o_orderkey, o_orderpriority,
         CAST((o_orderkey * 7) % {TERM_COUNT} AS INT) AS i1,
         CAST((o_orderkey * 11 + o_custkey) % {TERM_COUNT} AS INT) AS i2,
         CAST((o_custkey * 13 + 5) % {TERM_COUNT} AS INT) AS i3,
         CAST((o_orderkey * 17 + 3) % {TERM_COUNT} AS INT) AS i4,
         CAST((o_custkey * 19 + o_orderkey) % {TERM_COUNT} AS INT) AS i5,
         CAST((o_orderkey * 23 + o_custkey * 29) % {TERM_COUNT} AS INT) AS i6
  FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS n FROM {{orders}}) o
) p
JOIN {_TERMS} AS a(o1, t1) ON a.o1 = p.i1 JOIN {_TERMS} AS b(o2, t2) ON b.o2 = p.i2
JOIN {_TERMS} AS c(o3, t3) ON c.o3 = p.i3 JOIN {_TERMS} AS d(o4, t4) ON d.o4 = p.i4
JOIN {_TERMS} AS e(o5, t5) ON e.o5 = p.i5 JOIN {_TERMS} AS f(o6, t6) ON f.o6 = p.i6
"""

_VIEWS = {
    "skills": SKILLS, "jobs": JOBS, "job_skills": JOB_SKILLS, "skill_snapshots": SNAPSHOTS,
    "saved_jobs": SAVED_JOBS, "registry": REGISTRY, "postings": POSTINGS,
}


def view(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A logical table in Spark."""
    sql = _VIEWS[name]
    tables = {t: read_table(spark, root, t) for t in set(re.findall(r"{(\w+)}", sql))}
    if name == "postings":  # the rules over texts are CPU work
        tables = {t: spread(df) for t, df in tables.items()}
    return spark.sql(sql, **tables)


def sql_with(*names: str) -> str:
    """A WITH clause that defines logical tables in DuckDB."""
    parts = []
    for name in names:
        body = re.sub(r"{(\w+)}", r"\1", _VIEWS[name]).strip()
        parts.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n"
