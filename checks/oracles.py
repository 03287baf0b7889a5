"""SQL twins of the registered queries, written for DuckDB independently of the Spark code."""

from __future__ import annotations

from checks.payloads import HEAD_TEXT
from checks.queries import AS_OF, DISPLAY_AS_OF, FIRST_DAY, FUNNEL, LAUNCH
from checks.views import sql_text, sql_with
from millrace.functions import words
from millrace.sources.seed import hierarchy_pairs, starter_entries

ORACLES: dict[str, str] = {}

DEMAND = sql_with("jobs", "job_skills", "skills")
ACTIVE = "is_active"
MIN_SALARY = "is_active AND (salary_min >= 150000 OR salary_max >= 150000)"
PLACES = "is_active AND location_normalized IN ('Remote', 'Seattle', 'Boston')"
ROLES = "is_active AND role_category IN ('ML Engineer', 'Data Engineer')"


def _having_skill(pattern: str) -> str:
    return (
        "(external_id, source) IN (SELECT (external_id, source) FROM job_skills "
        f"WHERE lower(canonical_name) LIKE '{pattern}')"
    )


ALL_PARTS = (
    "is_active AND (salary_min >= 120000 OR salary_max >= 120000) "
    "AND location_normalized IN ('Remote', 'Austin', 'Miami', 'Phoenix') "
    "AND role_category IN ('ML Engineer', 'Clinical AI', 'AI / ML') AND " + _having_skill("%rag%")
)

# -- filters -----------------------------------------------------------------------------------------------

for _name, _where in {
    "filter_min_salary": MIN_SALARY,
    "filter_locations": PLACES,
    "filter_companies": "is_active AND company_name IN ("
    + ", ".join(f"'Customer#{n:09d}'" for n in (1, 5, 7, 10, 22, 40, 64, 100)) + ")",
    "filter_roles": ROLES,
    "filter_skill": "is_active AND " + _having_skill("%a_s%"),
    "filter_all_parts": ALL_PARTS,
}.items():
    ORACLES[_name] = sql_with("jobs", "job_skills") + f"""
        SELECT external_id, source, company_name, location_normalized, role_category, salary_min, salary_max
        FROM jobs WHERE {_where}"""

ORACLES["filter_skill_search"] = sql_with("jobs", "job_skills") + f"""
    SELECT external_id, source FROM jobs WHERE is_active AND {_having_skill('%c++%')}"""

ORACLES["filtered_jobs"] = DEMAND + f"""
    SELECT external_id, source, company_name, salary_min,
           string_agg(canonical_name || ':' || category, '|' ORDER BY canonical_name) AS skills
    FROM jobs LEFT JOIN job_skills USING (external_id, source) LEFT JOIN skills USING (canonical_name)
    WHERE {MIN_SALARY} GROUP BY ALL"""

ORACLES["newest_jobs"] = DEMAND + f""", feed AS (
      SELECT * FROM jobs WHERE {ROLES} ORDER BY fetched_at DESC, external_id, source LIMIT 50)
    SELECT external_id, source, CAST(fetched_at AS VARCHAR) AS fetched_at,
           array_to_string(list(canonical_name ORDER BY canonical_name) FILTER (canonical_name IS NOT NULL)[1:7], ', ')
             AS shown,
           COUNT(canonical_name)::INT AS skill_count
    FROM feed LEFT JOIN job_skills USING (external_id, source)
    GROUP BY external_id, source, fetched_at"""

ORACLES["saved_jobs"] = sql_with("jobs", "job_skills", "skills", "saved_jobs") + """
    SELECT external_id, source, notes, CAST(saved_at AS VARCHAR) AS saved_at, is_active,
           string_agg(canonical_name || ':' || category, '|' ORDER BY canonical_name) AS skills
    FROM saved_jobs JOIN jobs USING (external_id, source)
    LEFT JOIN job_skills USING (external_id, source) LEFT JOIN skills USING (canonical_name)
    GROUP BY external_id, source, notes, saved_at, is_active"""

# -- demand ------------------------------------------------------------------------------------------------


def _frequency(where: str, top_n: int) -> str:
    return f"""
    sel AS (SELECT * FROM jobs WHERE {where}),
    freq AS (
      SELECT canonical_name AS skill, category, COUNT(*) AS job_count,
             round(COUNT(*) / (SELECT COUNT(*) FROM sel) * 100, 1) AS pct
      FROM sel JOIN job_skills USING (external_id, source) JOIN skills USING (canonical_name)
      GROUP BY canonical_name, category ORDER BY job_count DESC, skill LIMIT {top_n})"""


def _per_category(where: str, top_n: int) -> str:
    return _frequency(where, top_n) + """,
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY job_count DESC, skill) AS INT)
                 AS category_rank FROM freq)"""


ORACLES["skill_frequency"] = DEMAND + "," + _frequency(ACTIVE, 30) + "SELECT * FROM freq"
ORACLES["frequency_csv"] = DEMAND + "," + _frequency(ACTIVE, 200) + "SELECT * FROM freq"
ORACLES["skill_frequency_filtered"] = DEMAND + "," + _frequency(ALL_PARTS, 25) + "SELECT * FROM freq"
ORACLES["skill_frequency_by_category"] = (
    DEMAND + "," + _per_category(ACTIVE, 200) + "SELECT * FROM ranked WHERE category_rank <= 10"
)
ORACLES["top_stack"] = DEMAND + "," + _per_category(ACTIVE, 60) + """
    SELECT * FROM ranked WHERE category_rank <= CASE category WHEN 'LLM Stack' THEN 4 WHEN 'Healthcare' THEN 3
      WHEN 'ML/DL' THEN 3 WHEN 'MLOps' THEN 3 ELSE 0 END"""
ORACLES["category_skill_rollup"] = DEMAND + "," + _frequency(ACTIVE, 30) + """
    SELECT category, skill, CAST(SUM(job_count) AS BIGINT) AS job_count FROM freq GROUP BY ROLLUP (category, skill)"""


def _top_paying(where: str, top_n: int, min_jobs: int) -> str:
    return DEMAND + f""",
    pay AS (
      SELECT canonical_name AS skill, category,
             list((salary_min + coalesce(nullif(salary_max, 0), salary_min)) / 2
                  ORDER BY salary_min + coalesce(nullif(salary_max, 0), salary_min)) AS mids
      FROM jobs JOIN job_skills USING (external_id, source) JOIN skills USING (canonical_name)
      WHERE {where} AND salary_min IS NOT NULL GROUP BY ALL)
    SELECT skill, category, CAST(floor(mids[len(mids) // 2 + 1]) AS BIGINT) AS median_salary,
           len(mids) AS job_count
    FROM pay WHERE len(mids) >= {min_jobs} ORDER BY median_salary DESC, skill LIMIT {top_n}"""


ORACLES["top_paying_skills"] = _top_paying(ACTIVE, 20, 2)
ORACLES["top_paying_skills_filtered"] = _top_paying(PLACES, 60, 3)

ORACLES["skill_combinations"] = sql_with("jobs", "job_skills") + """
    SELECT a.canonical_name AS skill_a, b.canonical_name AS skill_b, COUNT(*) AS co_count,
           a.canonical_name || ' + ' || b.canonical_name AS label
    FROM jobs j JOIN job_skills a USING (external_id, source) JOIN job_skills b USING (external_id, source)
    WHERE is_active AND a.canonical_name < b.canonical_name
    GROUP BY ALL HAVING COUNT(*) >= 2 ORDER BY co_count DESC, skill_a, skill_b LIMIT 20"""


def _roadmap(where: str, top_n: int) -> str:
    preferred = "CASE category " + " ".join(
        f"WHEN {sql_text(c)} THEN {i}" for i, c in enumerate(words.ROADMAP_ORDER)
    ) + " ELSE 100 END"
    return DEMAND + "," + _frequency(where, top_n) + f""",
    grouped AS (SELECT category, string_agg(skill, '|' ORDER BY job_count DESC, skill) AS skills,
                       MAX(job_count) AS best, arg_min(skill, (-job_count, skill)) AS first_skill
                FROM freq GROUP BY category)
    SELECT CAST(row_number() OVER (ORDER BY {preferred}, best DESC, first_skill) AS INT) AS cat_rank, category, skills
    FROM grouped"""


ORACLES["study_roadmap"] = _roadmap(ACTIVE, 40)
ORACLES["study_roadmap_for_role"] = _roadmap("is_active AND role_category = 'Data Engineer'", 25)

ORACLES["skills_summary_stats"] = sql_with("jobs", "job_skills") + f"""
    SELECT COUNT(*) AS total_jobs,
           (SELECT COUNT(DISTINCT canonical_name) FROM jobs JOIN job_skills USING (external_id, source) WHERE {ROLES})
             AS unique_skills,
           CAST(floor(avg(nullif(salary_min, 0))) AS BIGINT) AS avg_salary, COUNT(DISTINCT company_name) AS companies
    FROM jobs WHERE {ROLES}"""

ORACLES["last_updated"] = sql_with("jobs") + """
    SELECT strftime(MAX(fetched_at), '%b %d, %Y %I:%M %p') AS last_updated FROM jobs WHERE is_active"""

ORACLES["skill_export_order"] = sql_with("jobs", "job_skills") + f"""
    SELECT canonical_name AS skill, COUNT(*) AS job_count FROM jobs JOIN job_skills USING (external_id, source)
    WHERE {PLACES} GROUP BY 1"""

ORACLES["job_skill_matrix"] = sql_with("jobs", "job_skills") + """
    SELECT any_value(company_name) AS "Company", any_value(title) AS "Title", any_value(seniority) AS "Seniority",
           any_value(role_category) AS "Category", any_value(location_normalized) AS "Location",
           any_value(CASE WHEN is_remote THEN 'Yes' ELSE 'No' END) AS "Remote",
           any_value(salary_min) AS "Salary Min", any_value(salary_max) AS "Salary Max",
           any_value(strftime(posted_at, '%Y-%m-%d')) AS "Posted", url AS "URL",
           """ + ",\n           ".join(
    f'CAST(MAX(CASE WHEN canonical_name = {sql_text(e[2])} THEN 1 END) AS INT) AS "{e[2]}"' for e in starter_entries()
) + f"""
    FROM jobs LEFT JOIN job_skills USING (external_id, source) WHERE {PLACES} GROUP BY url"""

ORACLES["matrix_column_order"] = sql_with("jobs", "job_skills") + f"""
    SELECT CAST(row_number() OVER (ORDER BY COUNT(*) DESC, canonical_name) AS INT) AS place, canonical_name AS skill, COUNT(*) AS jobs
    FROM jobs JOIN job_skills USING (external_id, source) WHERE {PLACES} GROUP BY canonical_name"""

ORACLES["company_names"] = sql_with("jobs") + "SELECT DISTINCT company_name FROM jobs"


def _money(n: str) -> str:
    return f"'$' || format('{{:,}}', {n})"


ORACLES["job_cards"] = sql_with("jobs") + f"""
    SELECT external_id, source, upper(substr(company_name, 1, 1)) AS initial,
           CASE WHEN salary_min IS NULL THEN 'Not listed'
                WHEN salary_max IS NULL OR salary_max = salary_min THEN {_money('salary_min')}
                ELSE {_money('salary_min')} || ' – ' || {_money('salary_max')} END AS salary,
           CASE WHEN salary_min IS NULL THEN ''
                WHEN salary_max IS NULL OR salary_max = salary_min THEN {_money('salary_min')}
                ELSE {_money('salary_min')} || '–' || {_money('salary_max')} END AS salary_short,
           greatest(coalesce(salary_min, 0), coalesce(salary_max, 0)) >= 150000 AS meets_threshold,
           (salary_min + coalesce(salary_max, salary_min)) / 2 AS midpoint,
           CASE WHEN is_remote THEN 'Yes' ELSE 'No' END AS remote,
           strftime(posted_at, '%Y-%m-%d') AS posted
    FROM jobs"""

# -- trends ------------------------------------------------------------------------------------------------

TREND = sql_with("skill_snapshots", "skills")


def _window(days: int) -> str:
    return f"""trend AS (SELECT * FROM skill_snapshots JOIN skills USING (canonical_name)
      WHERE snapshot_date >= DATE '{AS_OF}' - {days})"""


ORACLES["skill_snapshot"] = sql_with("job_skills") + f"""
    SELECT '{AS_OF}' AS snapshot_date, canonical_name, COUNT(DISTINCT (external_id, source)) AS job_count
    FROM job_skills GROUP BY canonical_name"""
ORACLES["skill_trend"] = TREND + "," + _window(30) + """
    SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, canonical_name, category, job_count FROM trend"""


def _growth(days: int, top_n: int) -> str:
    return TREND + "," + _window(days) + f""",
    edge AS (SELECT MIN(snapshot_date) AS a, MAX(snapshot_date) AS b FROM trend)
    SELECT s.canonical_name AS skill, s.category, s.job_count AS count_start, e.job_count AS count_end,
           e.job_count - s.job_count AS growth
    FROM trend s JOIN trend e USING (canonical_name), edge
    WHERE s.snapshot_date = a AND e.snapshot_date = b AND a < b AND e.job_count > s.job_count
    ORDER BY growth DESC, skill LIMIT {top_n}"""


ORACLES["fastest_growing_skills"] = _growth(60, 15)
ORACLES["fastest_growing_recent"] = _growth(20, 40)
ORACLES["weekly_snapshot_summary"] = TREND + "," + _window(90) + """
    SELECT CAST(date_trunc('week', snapshot_date)::DATE AS VARCHAR) || '/'
             || CAST(date_trunc('week', snapshot_date)::DATE + 6 AS VARCHAR) AS week,
           canonical_name, category, CAST(SUM(job_count) AS BIGINT) AS weekly_jobs
    FROM trend GROUP BY ALL"""
ORACLES["category_trend"] = TREND + "," + _window(60) + """
    SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, category, CAST(SUM(job_count) AS BIGINT) AS total_jobs
    FROM trend GROUP BY ALL"""


def _pivot(days: int) -> str:
    from datetime import date, timedelta

    start = AS_OF - timedelta(days=days)
    dates = [start + timedelta(days=i) for i in range(days + 1)]
    columns = ", ".join(
        f"coalesce(AVG(CASE WHEN snapshot_date = DATE '{d}' THEN job_count END), 0.0) AS \"{d}\""
        for d in dates if d <= date(2024, 1, 30)
    )
    return TREND + "," + _window(days) + f" SELECT canonical_name, {columns} FROM trend GROUP BY canonical_name"


ORACLES["snapshot_pivot"] = _pivot(30)
ORACLES["trends_csv"] = _pivot(12)
ORACLES["top_skills_over_time"] = TREND + "," + _window(30) + """,
    best AS (SELECT canonical_name FROM trend GROUP BY 1 ORDER BY MAX(job_count) DESC, canonical_name LIMIT 10)
    SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, canonical_name, category, job_count
    FROM trend WHERE canonical_name IN (SELECT canonical_name FROM best)"""
ORACLES["snapshot_span"] = sql_with("skill_snapshots") + f"""
    SELECT COUNT(DISTINCT snapshot_date) AS dates, CAST(MIN(snapshot_date) AS VARCHAR) AS first_date,
           CAST(MAX(snapshot_date) AS VARCHAR) AS last_date
    FROM skill_snapshots WHERE snapshot_date >= DATE '{AS_OF}' - 30 HAVING MIN(snapshot_date) < MAX(snapshot_date)"""
ORACLES["snapshot_overwrite"] = sql_with("skill_snapshots") + """
    SELECT canonical_name, job_count, CAST(snapshot_date AS VARCHAR) AS snapshot_date
    FROM skill_snapshots WHERE snapshot_date < DATE '2024-01-20'
    UNION ALL
    SELECT event_type, COUNT(*), CAST(CAST(ts AS DATE) AS VARCHAR) FROM events WHERE ts >= '2024-01-20' GROUP BY 1, 3"""

# -- rules over texts --------------------------------------------------------------------------------------

POSTINGS = sql_with("postings")


def _bounded(terms: list[str]) -> str:
    return sql_text(r"\b(" + "|".join(terms) + r")\b")


def _labels(text: str, table: list[tuple[str, list[str]]], default: str) -> str:
    branches = " ".join(
        f"WHEN regexp_matches({text}, {_bounded(terms)}) THEN {sql_text(label)}" for label, terms in table
    )
    return f"CASE {branches} ELSE {sql_text(default)} END"


ROLE = _labels("lower(title || ' ' || substr(description, 1, 2000))", words.ROLE_WORDS, "AI / ML")
SENIORITY = _labels("lower(title)", words.SENIORITY_WORDS, "Mid-level")
EXCLUDED = f"regexp_matches(lower(title), {_bounded(words.EXCLUDED_TITLE_WORDS)})"
RELEVANT = f"regexp_matches(lower(title), {_bounded(words.RELEVANT_TITLE_WORDS)})"
MENTIONS = (
    f"len(regexp_extract_all(lower(substr(description, 1, 1500)), {_bounded(words.RELEVANT_DESCRIPTION_WORDS)})) >= 3"
)
IS_AI = f"(NOT {EXCLUDED} AND ({RELEVANT} OR {MENTIONS}))"
LOOKS_AI = (
    f"(NOT regexp_matches(lower(title), "
    f"{_bounded(words.DETAIL_EXCLUDED_WORDS + words.WORKDAY_EXTRA_EXCLUDED_WORDS)}) "
    f"AND regexp_matches(lower(title), {_bounded(words.DETAIL_TITLE_WORDS)}))"
)
ASHBY_LOOKS_AI = (
    f"(NOT regexp_matches(lower(title), {_bounded(words.DETAIL_EXCLUDED_WORDS)}) "
    f"AND regexp_matches(lower(title), {_bounded(words.DETAIL_TITLE_WORDS)}))"
)


def _abroad(text: str) -> str:
    """RE2 has no lookahead: what follows a remote dash is extracted and compared."""
    low = f"lower({text})"
    foreign = _bounded([w for w in words.FOREIGN_WORDS if "(?!" not in w])
    tier = (
        f"len(list_filter(regexp_extract_all({low}, '\\bremote\\s*-\\s*(\\w[\\w ]*)', 1), "
        "lambda x: NOT (starts_with(x, 'us') OR starts_with(x, 'united states')))) > 0"
    )
    return f"(regexp_matches({low}, {foreign}) OR {tier})"


def _place(text: str) -> str:
    low = f"lower({text})"
    branches = " ".join(
        "WHEN " + " OR ".join(f"contains({low}, {sql_text(a)})" for a in aliases) + f" THEN {sql_text(place)}"
        for place, aliases in words.LOCATION_ALIASES.items()
    )
    return f"CASE WHEN {_abroad(text)} THEN NULL {branches} END"


PLACE = _place("location")
POSTING_PLACE = f"coalesce({PLACE}, {_place('substr(description, 1, 300)')})"

ORACLES["classify_role"] = POSTINGS + f"SELECT external_id, source, {ROLE} AS role_category FROM postings"
ORACLES["classify_seniority"] = POSTINGS + f"SELECT external_id, source, {SENIORITY} AS seniority FROM postings"
ORACLES["ai_role_filter"] = POSTINGS + f"""
    SELECT external_id, source, {EXCLUDED} AS excluded, {RELEVANT} AS title_relevant, {IS_AI} AS is_ai_role,
           {LOOKS_AI} AS looks_ai FROM postings"""
ORACLES["normalize_location"] = POSTINGS + f"""
    SELECT external_id, source, {PLACE} AS place, {PLACE} IS NOT NULL AS is_us, {POSTING_PLACE} AS posting_place
    FROM postings"""

# The pay patterns in RE2's syntax.
_D = r"(?:USD\s*)?\$"
_N = r"(\d{1,3}(?:,\d{3})*|\d+)"
_B = r"(\d{1,3}(?:,\d{3})*|\d{5,7})"
_TO = r"\s*(?:[-–—]|to)\s*"
_PAY = [
    rf"{_D}\s*{_N}\s*k?{_TO}{_D}?\s*{_N}\s*k?",
    rf"(?:base\s+salary|base\s+pay|annual\s+salary|base\s+compensation)\s+(?:of\s+)?{_D}\s*{_N}\s*k?",
    rf"(?:total\s+compensation|total\s+comp|compensation|ote|tc)\s+(?:of\s+)?{_D}\s*{_N}\s*k?",
    rf"{_D}\s*{_N}\s*k?\s*(?:per\s+year|annually|/\s*year|/\s*yr|per\s+annum)",
    rf"salary\s+(?:range\s+)?(?:of\s+)?{_B}{_TO}{_B}",
]
_RATE = r"\$\s*(\d{2,4})\s*(?:[-–]?\s*\$\s*(\d{2,4}))?\s*(?:per\s+hour|/\s*hour|/\s*hr|hourly)"


def _pay_ctes(source: str, text: str, out: str) -> str:
    """CTE `out`: every row of `source` with lo, hi, raw read from `text`."""

    def group(pattern: str, n: int) -> str:
        return f"regexp_extract({text}, {sql_text('(?i)' + pattern)}, {n})"

    def yearly(digits: str) -> str:
        value = f"TRY_CAST(nullif(replace({digits}, ',', ''), '') AS BIGINT)"
        scaled = f"(CASE WHEN {value} < 1000 THEN {value} * 1000 ELSE {value} END)"
        return f"CASE WHEN {scaled} BETWEEN 50000 AND 2000000 THEN {scaled} END"

    def hourly(digits: str) -> str:
        value = f"TRY_CAST(nullif({digits}, '') AS BIGINT)"
        return f"CASE WHEN {value} BETWEEN 10 AND 500 THEN {value} * 2080 END"

    found = [f"{hourly(group(_RATE, 1))} AS l0, coalesce({hourly(group(_RATE, 2))}, {hourly(group(_RATE, 1))}) AS h0, "
             f"trim({group(_RATE, 0)}) AS r0"]
    for i, pattern in enumerate(_PAY, 1):
        last = 2 if pattern.count(_N) + pattern.count(_B) == 2 else 1
        found.append(f"{yearly(group(pattern, 1))} AS l{i}, {yearly(group(pattern, last))} AS h{i}, "
                     f"trim({group(pattern, 0)}) AS r{i}")
    ok = ["l0 >= 50000"] + [f"l{i} <= h{i}" for i in range(1, 6)]

    def pick(c: str) -> str:
        return "CASE " + " ".join(f"WHEN {cond} THEN {c}{i}" for i, cond in enumerate(ok)) + " END"

    return f"""{out}_found AS (SELECT *, {', '.join(found)} FROM {source}),
    {out} AS (SELECT * EXCLUDE ({', '.join(f'l{i}, h{i}, r{i}' for i in range(6))}),
                     CAST({pick('l')} AS INT) AS {out}_lo, CAST({pick('h')} AS INT) AS {out}_hi, {pick('r')} AS {out}_raw
              FROM {out}_found)"""


ORACLES["parse_salary"] = POSTINGS + "," + _pay_ctes("postings", "description", "parsed") + """
    SELECT external_id, source, parsed_lo AS salary_min, parsed_hi AS salary_max, parsed_raw AS salary_raw
    FROM parsed"""


def _enriched(source: str = "postings", more: str = "") -> str:
    return f"""relevant AS (
      SELECT * FROM (SELECT * REPLACE (coalesce(location, '') AS location), {POSTING_PLACE} AS location_normalized,
                            {ROLE} AS role_category, {SENIORITY} AS seniority
                     FROM {source} WHERE {IS_AI}) WHERE location_normalized IS NOT NULL),
    {_pay_ctes('relevant', 'salary_raw_meta', 'meta')},
    {_pay_ctes('meta', 'description', 'body')},
    enriched AS (
      SELECT external_id, source, company_name, title, location, location_normalized,
             CASE WHEN meta_lo IS NOT NULL THEN meta_lo ELSE body_lo END AS salary_min,
             CASE WHEN meta_lo IS NOT NULL THEN meta_hi ELSE body_hi END AS salary_max,
             CASE WHEN meta_lo IS NOT NULL THEN meta_raw ELSE body_raw END AS salary_raw,
             location_normalized = 'Remote' AS is_remote, url, description, role_category, seniority, posted_at{more}
      FROM body)"""


ORACLES["enriched_postings"] = POSTINGS + "," + _enriched() + """
    SELECT * REPLACE (CAST(posted_at AS VARCHAR) AS posted_at) FROM enriched"""
ORACLES["run_summary"] = sql_with("postings", "registry") + "," + _enriched() + """,
    named AS (SELECT DISTINCT name AS company_name FROM registry),
    judged AS (SELECT company_name, external_id AS seen, e.external_id IS NOT NULL AS stored
               FROM postings p LEFT JOIN (SELECT external_id, source FROM enriched) e USING (external_id, source))
    SELECT company_name, COUNT(*) FILTER (stored) AS stored, COUNT(seen) - COUNT(*) FILTER (stored) AS skipped
    FROM named FULL JOIN judged USING (company_name)
    GROUP BY ROLLUP (company_name)"""

_HIDDEN = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "template", "rt", "rp"))
_MARKUP = rf"""(?is)<!--.*?-->|{_HIDDEN}|<[/!?a-z](?:[^>"']|"[^"]*"|'[^']*')*>"""
ORACLES["clean_html"] = f"""
    SELECT page_id, array_to_string(list_filter(list_transform(
        string_split(regexp_replace(html, {sql_text(_MARKUP)}, chr(1), 'g'), chr(1)),
        lambda x: regexp_replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'),
               '&amp;', '&'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' ') AS text
    FROM pages"""
ORACLES["truncate_text"] = """
    SELECT doc_id, CASE WHEN text IS NULL THEN '' WHEN length(text) <= 300 THEN text
                        ELSE regexp_replace(substr(text, 1, 300), ' [^ ]*$', '') || '…' END AS text
    FROM documents"""
ORACLES["normalise_whitespace"] = r"""
    SELECT conv_id, turn, trim(regexp_replace(text, '[\s\p{Z}\x0B\x{85}]+', ' ', 'g')) AS text FROM conversations"""
ORACLES["time_ago"] = f"""
    SELECT event_id, CASE WHEN h < 1 THEN 'just now' WHEN h < 24 THEN h || 'h ago'
             WHEN h // 24 < 7 THEN (h // 24) || 'd ago' ELSE (h // 168) || 'w ago' END AS age
    FROM (SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '{DISPLAY_AS_OF}') - epoch_us(ts)) / 3600000000) AS BIGINT) AS h
          FROM events)"""

# -- dictionary matching -----------------------------------------------------------------------------------


_WORD = r"[\p{L}\p{M}\p{N}_]"
_NOT_WORD = r"[^\p{L}\p{M}\p{N}_]"
_MARK = r"[\s,;.()\[\]]"


# Whether a term stands somewhere between the right neighbours: `parts` is the text split at the term, and the
# pieces before and after each occurrence are looked at. `s` and `e` say what the term's ends need.
_STANDS = f"""len(list_filter(range(1, len(parts)), lambda i:
      ((i = 1 AND parts[i] = '') OR CASE s WHEN 'w' THEN regexp_matches(parts[i], '{_NOT_WORD}$')
                                            ELSE regexp_matches(parts[i], '{_MARK}$') END)
      AND CASE WHEN e = '+' THEN regexp_matches(parts[i + 1], '^{_WORD}')
               WHEN i + 1 = len(parts) AND parts[i + 1] = '' THEN TRUE
               WHEN e = 'w' THEN regexp_matches(parts[i + 1], '^{_NOT_WORD}')
               ELSE regexp_matches(parts[i + 1], '^{_MARK}') END)) > 0"""


def _standing(rows: str, term_table: str, keep: str) -> str:
    """Rows of `rows(low, ...)` and terms that stand in them."""
    return f"""SELECT DISTINCT {keep} FROM (
      SELECT *, string_split(low, term) AS parts FROM {rows} JOIN {term_table} ON contains(low, term))
    WHERE {_STANDS}"""


def _dictionary() -> str:
    owners: dict[str, str] = {}
    for key, aliases, canonical, *_ in starter_entries():
        for term in [key, *aliases]:
            owners.setdefault(term.lower(), canonical)
    def ends(term: str) -> str:
        last = "w" if term[-1].isalnum() else "+" if term[-1] == "+" else "m"
        return f"'{'w' if term[0].isalnum() else 'm'}', '{last}'"

    rows = ", ".join(f"({sql_text(t)}, {sql_text(c)}, {ends(t)})" for t, c in owners.items())
    return f"dict(term, canonical, s, e) AS (VALUES {rows})"


_HIERARCHY = "hier(parent, child) AS (VALUES " + ", ".join(
    f"({sql_text(p)}, {sql_text(c)})" for p, c in hierarchy_pairs()
) + ")"


def _extracted(source: str) -> str:
    return f"""{_dictionary()}, {_HIERARCHY},
    low_texts AS (SELECT external_id, source, lower(description) AS low FROM {source}),
    found AS MATERIALIZED ({_standing('low_texts', 'dict', 'external_id, source, canonical')}),
    broad AS MATERIALIZED (SELECT DISTINCT external_id, source, parent AS canonical
                           FROM found JOIN hier ON found.canonical = child),
    kept AS (SELECT * FROM found ANTI JOIN broad USING (external_id, source, canonical))"""


ORACLES["extract_skills"] = POSTINGS + "," + _extracted("postings") + "SELECT * FROM kept"
ORACLES["extract_skills_by_join"] = ORACLES["extract_skills"]
ORACLES["extract_skills_unsuppressed"] = POSTINGS + "," + _extracted("postings") + "SELECT * FROM found"
ORACLES["document_terms"] = f"""
    WITH terms AS (
      SELECT DISTINCT unnest(list_concat(regexp_extract_all(lower(text), '[a-z]+ [a-z]+ [a-z]+'),
                                         regexp_extract_all(lower(text), '[a-z]{{8,}}'))) AS term,
                      'w' AS s, 'w' AS e FROM benchmark),
    low_texts AS (SELECT doc_id, lower(text) AS low FROM documents)
    {_standing('low_texts', 'terms', 'doc_id, term')}"""

_PART_TERMS = """terms AS (
      SELECT lower(t) AS term, pos, p_brand AS canonical, p_type AS category, '' AS subcategory, p_partkey AS ord
      FROM (SELECT *, unnest([p_name, upper(p_type), p_brand]) AS t, unnest([0, 1, 2]) AS pos FROM part)),
    prepared AS (
      SELECT term, canonical, category, subcategory, ord
      FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ord, pos) AS rn FROM terms) WHERE rn = 1)"""
ORACLES["dictionary_preparation"] = f"WITH {_PART_TERMS} SELECT * FROM prepared"
ORACLES["dictionary_skill_dimension"] = f"""WITH {_PART_TERMS}
    SELECT canonical AS canonical_name, arg_min(category, (ord, category)) AS category, '' AS subcategory
    FROM prepared GROUP BY canonical"""
ORACLES["skill_categories"] = f"WITH {_PART_TERMS} SELECT DISTINCT category FROM prepared"

# -- sources -----------------------------------------------------------------------------------------------

_TEXT = f"'{HEAD_TEXT}' || description"
_PLACE_OR_EMPTY = "coalesce(location, '')"
_RAW = """SELECT external_id, '{source}' AS source, company_name, title, {location} AS location, {url} AS url,
           {description} AS description, CAST({posted} AS VARCHAR) AS posted_at, {salary} AS salary_raw_meta"""
_NONE = "CAST(NULL AS VARCHAR)"

ORACLES["normalise_greenhouse"] = POSTINGS + _RAW.format(
    source="greenhouse", location=_PLACE_OR_EMPTY, url="url", description=_TEXT,
    posted="posted_at + INTERVAL 5 HOUR",
    salary="CASE WHEN o_orderpriority <> '5-LOW' THEN coalesce(salary_raw_meta, '') END",
) + " FROM postings"
ORACLES["stream_ingest"] = ORACLES["normalise_greenhouse"]
ORACLES["normalise_lever"] = POSTINGS + _RAW.format(
    source="lever", location=_PLACE_OR_EMPTY,
    url="CASE WHEN o_orderpriority = '1-URGENT' THEN url ELSE url || '/apply' END",
    description=f"{_TEXT} || ' ' || pay || ' ' || t1 || ' more'", posted="posted_at", salary=_NONE,
) + " FROM postings"


def _ashby_rich(where: str, slug: str) -> str:
    return _RAW.format(
        source="ashby",
        location=f"CASE WHEN o_orderpriority = '3-MEDIUM' AND {_PLACE_OR_EMPTY} = '' THEN 'Remote' "
                 f"ELSE {_PLACE_OR_EMPTY} END",
        url=f"CASE WHEN o_orderpriority = '1-URGENT' THEN url "
            f"ELSE 'https://jobs.ashbyhq.com/' || {slug} || '/' || external_id END",
        description=_TEXT, posted="posted_at", salary="CASE WHEN o_orderpriority = '2-HIGH' THEN pay END",
    ) + f" FROM postings WHERE {where}"


_BOARD = "slug || '-' || substr(o_orderpriority, 1, 1)"
ORACLES["normalise_ashby"] = POSTINGS + _ashby_rich("o_orderpriority <> '5-LOW'", "slug")
ORACLES["normalise_ashby_fallback"] = (
    POSTINGS + _ashby_rich("o_orderpriority IN ('1-URGENT', '2-HIGH')", _BOARD) + " UNION ALL " + _RAW.format(
        source="ashby", location=_PLACE_OR_EMPTY,
        url=f"'https://jobs.ashbyhq.com/' || {_BOARD} || '/' || external_id",
        description=f"CASE WHEN {ASHBY_LOOKS_AI} THEN {_TEXT} ELSE '' END",
        posted=f"CASE WHEN {ASHBY_LOOKS_AI} THEN posted_at END",
        salary=f"CASE WHEN {ASHBY_LOOKS_AI} THEN pay END",
    ) + " FROM postings WHERE o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED')"
)
_PATH = "CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE '/job/' || external_id END"
_DETAILED = f"({LOOKS_AI} AND o_orderpriority <> '5-LOW')"


def _workday() -> str:
    return _RAW.replace("SELECT external_id,", f"""SELECT CASE WHEN NOT {_DETAILED} THEN {_PATH}
             WHEN o_orderpriority = '1-URGENT' THEN 'P' || external_id ELSE 'R' || external_id END AS external_id,""")


ORACLES["normalise_workday"] = POSTINGS + _workday().format(
    source="workday", location=_PLACE_OR_EMPTY,
    url=f"CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE "
        f"'https://' || slug || '.wd5.myworkdayjobs.com/Careers' || {_PATH} END",
    description=f"CASE WHEN {_DETAILED} THEN {_TEXT} ELSE '' END",
    posted=f"CASE WHEN {_DETAILED} AND o_orderpriority = '1-URGENT' THEN posted_at - INTERVAL 2 HOUR ELSE posted_at END",
    salary=_NONE,
) + " FROM postings"
ORACLES["normalise_workday_pages"] = ORACLES["normalise_workday"]
ORACLES["workday_incomplete_boards"] = """
    SELECT 'c' || o_custkey AS slug, 'Careers' AS board, COUNT(*) AS landed, 12 AS reported
    FROM orders GROUP BY o_custkey HAVING COUNT(*) < 12"""
ORACLES["all_sources"] = sql_with("postings", "registry") + """
    SELECT r.ats_type AS source, r.name AS company_name, COUNT(*) AS postings, COUNT(DISTINCT title) AS titles
    FROM postings p JOIN registry r USING (slug)
    WHERE ats_type <> 'bulletin' AND NOT (ats_type = 'ashby' AND o_orderpriority = '5-LOW') GROUP BY 1, 2"""
ORACLES["registry_scan"] = sql_with("registry") + "SELECT name, ats_type, slug, career_url FROM registry"
ORACLES["unknown_sources"] = sql_with("registry") + """
    SELECT name, ats_type, CAST(0 AS BIGINT) AS stored, CAST(0 AS BIGINT) AS skipped
    FROM registry WHERE ats_type = 'bulletin'"""

# -- merges ------------------------------------------------------------------------------------------------

ORACLES["merge_company"] = sql_with("registry") + """,
    old AS (SELECT name, slug, ats_type, career_url FROM registry JOIN customer ON c_name = name WHERE c_acctbal > 0),
    reports AS (
      SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name, 'c' || o_custkey || '-' || o_orderpriority AS slug,
             o_orderstatus AS ats_type, o_orderdate AS seen_at, o_orderkey AS seq,
             CASE WHEN o_totalprice < 300000 THEN '' ELSE 'https://careers.example.com/' || o_orderkey END AS career_url
      FROM orders
      UNION ALL
      SELECT name, slug, ats_type, TIMESTAMP '1994-01-01', 0, career_url
      FROM registry JOIN customer ON c_name = name WHERE NOT c_acctbal > 0),
    new AS (
      SELECT name, last(slug ORDER BY seen_at, seq) AS slug, last(ats_type ORDER BY seen_at, seq) AS ats_type,
             last(career_url ORDER BY seen_at, seq) FILTER (career_url <> '') AS career_url, MIN(seen_at) AS created_at
      FROM reports GROUP BY 1)
    SELECT name, coalesce(n.slug, o.slug) AS slug, coalesce(n.ats_type, o.ats_type) AS ats_type,
           coalesce(n.career_url, o.career_url, '') AS career_url,
           CAST(CASE WHEN o.name IS NOT NULL THEN TIMESTAMP '1994-01-01' ELSE n.created_at END AS VARCHAR) AS created_at
    FROM old o FULL JOIN new n USING (name)"""

_SOURCE = "CASE l_orderkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'workday' END"
_BATCH = f"""batch AS (
      SELECT CAST(l_orderkey AS VARCHAR) AS external_id, {_SOURCE} AS source, 'Supplier#' || l_suppkey AS company_name,
             'Line ' || l_linenumber || ' ' || l_linestatus AS title, 'Dock ' || l_returnflag AS location,
             CASE WHEN l_returnflag <> 'R' THEN CAST(floor(l_extendedprice) AS INT) END AS pay,
             'u' || l_partkey AS url, l_shipdate AS seen_at
      FROM lineitem)"""
_LAST = "ORDER BY seen_at, title, pay NULLS FIRST, pay_max NULLS FIRST, url"
ORACLES["merge_job"] = sql_with("jobs") + f""",
    old AS (SELECT * FROM jobs WHERE posted_at < '2000-01-01'), {_BATCH},
    records AS (
      SELECT external_id, source, company_name, title, location, 'Remote' AS place, pay, pay + 500 AS pay_max, url,
             'Data Engineer' AS role, 'Senior' AS level, seen_at FROM batch
      UNION ALL
      SELECT external_id, source, company_name, title, location, location_normalized, salary_min, salary_max, url,
             role_category, seniority, posted_at FROM jobs WHERE posted_at >= '2000-01-01'),
    new AS (
      SELECT external_id, source, first(company_name ORDER BY seen_at, company_name, location) AS company_name,
             last(title {_LAST}) AS title, first(location ORDER BY seen_at, company_name, location) AS location,
             first(place ORDER BY seen_at, company_name, location) AS place, last(pay {_LAST}) AS pay,
             last(pay_max {_LAST}) AS pay_max, last(url {_LAST}) AS url, last(role {_LAST}) AS role,
             last(level {_LAST}) AS level, MIN(seen_at) AS first_at, MAX(seen_at) AS last_at
      FROM records GROUP BY 1, 2)
    SELECT external_id, source, coalesce(o.company_name, n.company_name) AS company_name,
           coalesce(n.title, o.title) AS title, coalesce(o.location, n.location) AS location,
           coalesce(o.location_normalized, n.place) AS location_normalized,
           CASE WHEN n.title IS NULL THEN o.salary_min ELSE n.pay END AS salary_min,
           CASE WHEN n.title IS NULL THEN o.salary_max ELSE n.pay_max END AS salary_max,
           coalesce(n.url, o.url) AS url,
           CASE WHEN n.title IS NULL THEN o.role_category ELSE n.role END AS role_category,
           CASE WHEN n.title IS NULL THEN o.seniority ELSE n.level END AS seniority,
           CAST(coalesce(o.posted_at, n.first_at) AS VARCHAR) AS posted_at,
           CAST(coalesce(n.last_at, o.fetched_at) AS VARCHAR) AS fetched_at,
           CASE WHEN n.title IS NULL THEN o.is_active ELSE TRUE END AS is_active
    FROM old o FULL JOIN new n USING (external_id, source)"""
ORACLES["merge_job_twice"] = ORACLES["merge_job"]
ORACLES["newest_record_per_key"] = f"""WITH {_BATCH}
    SELECT external_id, source, last(title ORDER BY seen_at, title, url) AS title, last(url ORDER BY seen_at, title, url) AS url,
           CAST(MAX(seen_at) AS VARCHAR) AS fetched_at FROM batch GROUP BY 1, 2"""
ORACLES["key_violations"] = f"""WITH {_BATCH}
    SELECT external_id, source, COUNT(*) AS copies FROM batch GROUP BY 1, 2 HAVING COUNT(*) > 1"""
ORACLES["merge_skill"] = """
    WITH old AS (SELECT DISTINCT p_name AS canonical_name, 'stored' AS category, '' AS subcategory
                 FROM part WHERE p_size >= 49)
    SELECT * FROM old UNION ALL
    SELECT p_name, arg_min(p_type, p_partkey), arg_min(p_brand, p_partkey) FROM part
    WHERE p_name NOT IN (SELECT canonical_name FROM old) GROUP BY 1"""
_MORE = f"""more AS (SELECT CAST(l_orderkey AS VARCHAR) AS external_id, {_SOURCE} AS source,
                            'Supplier skill ' || (l_suppkey % 9) AS canonical_name FROM lineitem)"""
ORACLES["insert_or_ignore_links"] = sql_with("job_skills") + f""", {_MORE}
    SELECT external_id, source, canonical_name FROM job_skills UNION SELECT * FROM more"""
ORACLES["relink_jobs"] = sql_with("job_skills") + f""", {_MORE},
    batch AS (SELECT * FROM more WHERE external_id IN
                (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'))
    SELECT external_id, source, canonical_name FROM job_skills
    WHERE (external_id, source) NOT IN (SELECT (external_id, source) FROM batch) UNION SELECT * FROM batch"""
ORACLES["save_job"] = sql_with("saved_jobs") + f"""
    SELECT external_id, source, notes, CAST(saved_at AS VARCHAR) AS saved_at FROM saved_jobs UNION ALL
    SELECT CAST(l_orderkey AS VARCHAR), {_SOURCE},
           first('quantity ' || CAST(l_quantity AS INT) ORDER BY l_shipdate, 'quantity ' || CAST(l_quantity AS INT)),
           CAST(MIN(l_shipdate) AS VARCHAR)
    FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) NOT IN (SELECT external_id FROM saved_jobs)
    GROUP BY l_orderkey"""
ORACLES["quarantined_postings"] = POSTINGS + """
    SELECT o_orderkey, location FROM postings WHERE location IS NULL OR location = ''"""

# -- refresh -----------------------------------------------------------------------------------------------

ORACLES["refresh_jobs"] = sql_with("postings", "jobs") + "," + _enriched() + """,
    old AS (SELECT * FROM jobs WHERE posted_at < '1998-01-01')
    SELECT external_id, source, coalesce(o.company_name, n.company_name) AS company_name,
           coalesce(n.title, o.title) AS title, coalesce(o.location, n.location) AS location,
           coalesce(o.location_normalized, n.location_normalized) AS location_normalized,
           CASE WHEN n.title IS NULL THEN o.salary_min ELSE n.salary_min END AS salary_min,
           CASE WHEN n.title IS NULL THEN o.salary_max ELSE n.salary_max END AS salary_max,
           coalesce(n.role_category, o.role_category) AS role_category, coalesce(n.seniority, o.seniority) AS seniority,
           CAST(coalesce(o.posted_at, n.posted_at) AS VARCHAR) AS posted_at,
           CAST(CASE WHEN n.title IS NULL THEN o.fetched_at ELSE TIMESTAMP '2002-01-01' END AS VARCHAR) AS fetched_at,
           CASE WHEN n.title IS NULL THEN o.is_active ELSE TRUE END AS is_active
    FROM old o FULL JOIN enriched n USING (external_id, source)"""
ORACLES["refresh_snapshot"] = sql_with("postings", "job_skills") + "," + _enriched() + "," + _extracted("enriched") + f"""
    SELECT '{AS_OF}' AS snapshot_date, canonical_name, COUNT(*) AS job_count
    FROM (SELECT external_id, source, canonical_name FROM job_skills UNION SELECT external_id, source, canonical FROM kept)
    GROUP BY canonical_name"""

def _board_rows(source: str, where: str = "TRUE", **fields: str) -> str:
    return _RAW.format(source=source, **fields) + f", wave, place FROM records WHERE ats_type = '{source}' AND {where}"


ORACLES["streamed_refresh"] = sql_with("postings", "registry") + f""",
    known AS (SELECT p.* EXCLUDE (source), r.ats_type FROM postings p JOIN registry r USING (slug)),
    records AS (
      SELECT *, 1 AS wave, 0 AS place FROM known UNION ALL
      SELECT * REPLACE (title || ' Z' AS title, url || '/z' AS url), 1, 1 FROM known WHERE o_orderkey % 5 = 0 UNION ALL
      SELECT * REPLACE (title || ' A' AS title, url || '/a' AS url, 'Remote - US' AS location), 2, 0
      FROM known WHERE o_orderkey % 3 = 0),
    raw AS ({_board_rows("greenhouse", location=_PLACE_OR_EMPTY, url="url", description=_TEXT,
                         posted="posted_at + INTERVAL 5 HOUR",
                         salary="CASE WHEN o_orderpriority <> '5-LOW' THEN coalesce(salary_raw_meta, '') END")}
      UNION ALL {_board_rows("lever", location=_PLACE_OR_EMPTY,
                             url="CASE WHEN o_orderpriority = '1-URGENT' THEN url ELSE url || '/apply' END",
                             description=f"{_TEXT} || ' ' || pay || ' ' || t1 || ' more'", posted="posted_at", salary=_NONE)}
      UNION ALL {_board_rows("ashby", "o_orderpriority <> '5-LOW'",
                             location=f"CASE WHEN o_orderpriority = '3-MEDIUM' AND {_PLACE_OR_EMPTY} = '' THEN 'Remote' "
                                      f"ELSE {_PLACE_OR_EMPTY} END",
                             url="CASE WHEN o_orderpriority = '1-URGENT' THEN url "
                                 "ELSE 'https://jobs.ashbyhq.com/' || slug || '/' || external_id END",
                             description=_TEXT, posted="posted_at",
                             salary="CASE WHEN o_orderpriority = '2-HIGH' THEN pay END")}),
    {_enriched("raw", ", wave, place")}, {_extracted("enriched")},
    linked AS (SELECT external_id, source, string_agg(DISTINCT canonical, '|' ORDER BY canonical) AS skills FROM kept GROUP BY ALL),
    done AS (
      SELECT external_id, source, {", ".join(
          f"arg_min({c}, wave * 10 + place) AS {c}" for c in ("company_name", "location", "location_normalized", "is_remote", "posted_at"))},
             {", ".join(f"last({c} ORDER BY wave, place) AS {c}" for c in (
                 "title", "salary_min", "salary_max", "salary_raw", "url", "role_category", "seniority"))}
      FROM enriched GROUP BY external_id, source)
    SELECT done.*, '2002-01-01 00:00:00' AS fetched_at, TRUE AS is_active, skills, ats_type
    FROM done LEFT JOIN linked USING (external_id, source) JOIN registry ON name = company_name"""

# -- streams -----------------------------------------------------------------------------------------------

ORACLES["stream_daily_counts"] = """
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS snapshot_date, event_type AS canonical_name,
           COUNT(DISTINCT user_id) AS job_count
    FROM events GROUP BY CAST(ts AS DATE), event_type"""
ORACLES["stream_dedupe_postings"] = """
    SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS external_id, l_returnflag AS source FROM lineitem"""

# -- behaviour over time -----------------------------------------------------------------------------------


def _chains() -> str:
    """The earliest way through the steps from every first event: events between a step and the next, tried by time."""
    out = f"""steps AS MATERIALIZED (SELECT user_id, event_type, ts, event_id, (ts, event_id) AS moment FROM events),
    done1 AS (SELECT user_id, ts AS began, event_id AS id, moment FROM steps WHERE event_type = '{FUNNEL[0]}')"""
    for k, step in enumerate(FUNNEL[1:], 2):
        out += f""",
    done{k} AS (SELECT d.user_id, d.began, d.id, min(s.moment) AS moment FROM done{k - 1} d JOIN steps s ON s.user_id = d.user_id
             AND s.event_type = '{step}' AND s.moment > d.moment AND s.ts <= d.began + INTERVAL 2 DAY GROUP BY ALL)"""
    return out


ORACLES["funnel_rates"] = f"WITH {_chains()}, users AS (" + " UNION ALL ".join(
    f"SELECT {k} AS step, '{s}' AS event_type, COUNT(DISTINCT user_id) AS users FROM done{k}" for k, s in enumerate(FUNNEL, 1)
) + """)
    SELECT step, event_type, users, users / nullif(coalesce(lag(users) OVER (ORDER BY step), users), 0) AS rate_of_previous,
           users / nullif(first(users) OVER (ORDER BY step), 0) AS rate_of_first FROM users"""
ORACLES["funnel_entries"] = f"""WITH {_chains()},
    best AS (SELECT user_id, epoch_us(began) // 172800000000 AS start, 1 + (d2.id IS NOT NULL)::INT + (d3.id IS NOT NULL)::INT
                    + (d4.id IS NOT NULL)::INT AS steps_done
             FROM done1 LEFT JOIN done2 d2 USING (user_id, began, id) LEFT JOIN done3 d3 USING (user_id, began, id)
             LEFT JOIN done4 d4 USING (user_id, began, id))
    SELECT start, steps_done, COUNT(*) AS users FROM (
      SELECT user_id, start, MAX(steps_done) AS steps_done FROM best GROUP BY 1, 2) GROUP BY 1, 2"""
ORACLES["cohort_retention"] = f"""
    WITH seen AS (SELECT DISTINCT user_id, CAST(ts AS DATE) - DATE '{FIRST_DAY}' AS p FROM events),
    firsts AS (SELECT user_id, MIN(p) AS first FROM seen WHERE p BETWEEN 0 AND 69 GROUP BY 1),
    sizes AS (SELECT first, COUNT(*) AS users, unnest(range(0, 70 - first)) AS period FROM firsts GROUP BY first)
    SELECT CAST(DATE '{FIRST_DAY}' + CAST(z.first AS INT) AS VARCHAR) AS cohort, period, users, COUNT(s.user_id) AS active,
           round(COUNT(s.user_id) / users, 6) AS rate
    FROM sizes z JOIN firsts f ON f.first = z.first LEFT JOIN seen s ON s.user_id = f.user_id AND s.p = z.first + z.period
    GROUP BY z.first, period, users"""
_ITEM = "CAST(json_extract_string(props, '$.k') AS INT)"
_DAILY = f"""
    WITH counts AS (SELECT {_ITEM} AS series, CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1, 2),
    days AS (SELECT CAST(unnest(generate_series(MIN(day), MAX(day), INTERVAL 1 DAY)) AS DATE) AS day FROM counts),
    daily AS MATERIALIZED (SELECT series, day, coalesce(n, 0) AS n
              FROM (SELECT DISTINCT series FROM counts) CROSS JOIN days LEFT JOIN counts USING (series, day)),
    first AS (SELECT MIN(day) AS d0 FROM days)"""


def _sum_days(back: int, until: int, what: str = "SUM(n)", table: str = "d") -> str:
    """By a correlated look at each single day, not by a frame."""
    return (f"(SELECT {what} FROM daily x WHERE x.series = {table}.series AND x.day BETWEEN {table}.day - {back} "
            f"AND {table}.day - {until})")


ORACLES["daily_growth"] = _DAILY + f""",
    spans AS (SELECT series, day, n, CASE WHEN day - 6 >= d0 THEN {_sum_days(6, 0)} END::BIGINT AS week,
                     CASE WHEN day - 13 >= d0 THEN {_sum_days(13, 7)} END::BIGINT AS week_before FROM daily d, first)
    SELECT series, CAST(day AS VARCHAR) AS day, n, week, week_before,
           round((week - week_before) / nullif(week_before, 0), 6) AS growth FROM spans"""
ORACLES["trend_velocity"] = _DAILY + f""",
    prior AS (SELECT AVG(n) AS m, VAR_POP(n) AS v FROM daily),
    rates AS (
      SELECT series, day, n, CASE WHEN v <= m THEN m ELSE
               (m * m / (v - m) + coalesce({_sum_days(6, 0)}, 0)) / (m / (v - m) + {_sum_days(6, 0, "COUNT(*)")}) END AS recent,
             CASE WHEN v <= m THEN m ELSE
               (m * m / (v - m) + coalesce({_sum_days(27, 7)}, 0)) / (m / (v - m) + {_sum_days(27, 7, "COUNT(*)")}) END AS base
      FROM daily d, prior)
    SELECT series, CAST(day AS VARCHAR) AS day, n, round(recent, 6) AS recent_rate, round(base, 6) AS base_rate,
           round(recent / nullif(base, 0), 6) AS velocity FROM rates"""
ORACLES["count_spikes"] = _DAILY + f""",
    middle AS (SELECT series, day, n, CASE WHEN day - 14 >= d0 THEN {_sum_days(14, 1, "MEDIAN(n)")} END AS med FROM daily d, first),
    spread AS (SELECT *, CASE WHEN med IS NOT NULL THEN {_sum_days(14, 1, "MEDIAN(abs(x.n - d.med))")} END AS mad FROM middle d),
    scored AS (SELECT *, (n - med) / CASE WHEN mad = 0 THEN 1.0 ELSE mad * 1.4826 END AS score FROM spread)
    SELECT series, CAST(day AS VARCHAR) AS day, n, round(med, 6) AS median, round(mad, 6) AS mad, round(score, 6) AS score,
           CASE WHEN score >= 2 THEN 1 WHEN score <= -2 THEN -1 ELSE 0 END AS spike FROM scored"""

# -- experiments -------------------------------------------------------------------------------------------

_UNIFORM = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) / 4294967296"
_UNITS = f"""
    WITH users AS (SELECT user_id, coalesce(SUM(c) FILTER (ts < '{LAUNCH}'), 0) AS x, coalesce(SUM(c) FILTER (ts >= '{LAUNCH}'), 0) AS y
                   FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events) GROUP BY 1),
    units AS MATERIALIZED (SELECT user_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y,
              CASE WHEN {_UNIFORM.format("'launch|' || user_id")} < 0.5 THEN 'control' ELSE 'feed' END AS variant FROM users)"""
# The tail of Student's t as an integral over the angle whose tangent is t / sqrt(df), by Simpson's rule.
ORACLES["experiment_readout"] = _UNITS + """,
    theta AS (SELECT SUM((x - ax) * (y - ay)) / SUM((x - ax) * (x - ax)) AS theta, AVG(x) AS all_x
              FROM (SELECT *, AVG(x) OVER (PARTITION BY variant) AS ax, AVG(y) OVER (PARTITION BY variant) AS ay FROM units)),
    adjusted AS (SELECT variant, 'plain' AS method, y FROM units
                 UNION ALL SELECT variant, 'cuped', y - theta * (x - all_x) FROM units, theta),
    sides AS (SELECT variant, method, COUNT(*) AS n, AVG(y) AS mean, VAR_SAMP(y) / COUNT(*) AS e FROM adjusted GROUP BY 1, 2),
    pairs AS (SELECT a.variant, a.method, a.n, a.mean, (a.mean - b.mean) / b.mean AS lift, (a.mean - b.mean) / sqrt(a.e + b.e) AS t,
                     (a.e + b.e) ** 2 / (a.e ** 2 / (a.n - 1) + b.e ** 2 / (b.n - 1)) AS df
              FROM sides a JOIN sides b USING (method) WHERE b.variant = 'control' AND a.variant <> 'control'),
    grid AS (SELECT *, atan(abs(t) / sqrt(df)) AS low, (pi() / 2 - atan(abs(t) / sqrt(df))) / 20000 AS h,
                    unnest(range(0, 20001)) AS i FROM pairs),
    tails AS (SELECT variant, method, SUM(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                       * greatest(cos(low + i * h), 0) ** (df - 1)) * any_value(h) / 3 AS area FROM grid GROUP BY 1, 2)
    SELECT variant, method, n, round(mean, 6) AS mean, round(lift, 6) AS lift, round(t, 6) AS t, round(df, 6) AS df,
           round(2 * area * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()), 6) AS p
    FROM pairs JOIN tails USING (variant, method)"""
ORACLES["experiment_bootstrap"] = _UNITS + f""",
    chances AS (SELECT i, SUM(exp(-1) / gamma(i + 1)) OVER (ORDER BY i) AS upto FROM range(0, 12) t(i)),
    drawn AS (SELECT variant, y, r, {_UNIFORM.format("'bootstrap|' || user_id || '|' || r")} AS u
              FROM units, range(1, 201) t(r)),
    weighted AS (SELECT variant, r, y, (SELECT COUNT(*) FROM chances WHERE upto <= u) AS w FROM drawn),
    means AS (SELECT variant, r, SUM(w * y) / nullif(SUM(w), 0) AS mean FROM weighted GROUP BY 1, 2),
    diffs AS (SELECT a.variant, a.mean - b.mean AS d FROM means a JOIN means b USING (r)
              WHERE a.variant <> 'control' AND b.variant = 'control'),
    plain AS (SELECT variant, AVG(y) AS mean FROM units GROUP BY 1)
    SELECT d.variant, round(any_value(a.mean - b.mean), 6) AS difference, round(quantile_cont(d, 0.025), 6) AS low,
           round(quantile_cont(d, 0.975), 6) AS high
    FROM diffs d JOIN plain a ON a.variant = d.variant JOIN plain b ON b.variant = 'control' GROUP BY d.variant"""

# -- recommendation ----------------------------------------------------------------------------------------

ORACLES["similar_items"] = f"""
    WITH w AS MATERIALIZED (SELECT {_ITEM} AS item, user_id, COUNT(*) AS w FROM events GROUP BY 1, 2),
    norms AS (SELECT item, SUM(w * w) AS n FROM w GROUP BY 1),
    pairs AS (SELECT a.item AS item_a, b.item AS item_b, COUNT(*) AS users, SUM(a.w * b.w) AS dot
              FROM w a JOIN w b ON a.user_id = b.user_id AND a.item < b.item GROUP BY 1, 2)
    SELECT item_a, item_b, users, round(dot / sqrt(x.n * y.n), 6) AS similarity
    FROM pairs JOIN norms x ON x.item = item_a JOIN norms y ON y.item = item_b WHERE dot / sqrt(x.n * y.n) >= 0.42"""
ORACLES["ranking_metrics"] = f"""
    WITH acts AS (SELECT user_id, event_type, ts, {_ITEM} AS item FROM events),
    ranked AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, item) AS rank
               FROM acts WHERE ts < '{LAUNCH}' GROUP BY 1, 2),
    gains AS (SELECT user_id, item, MAX(CASE event_type WHEN 'purchase' THEN 3 ELSE 1 END) AS gain FROM acts
              WHERE ts >= '{LAUNCH}' AND event_type IN ('purchase', 'click') GROUP BY 1, 2),
    ideal AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gain DESC) AS place FROM gains),
    ks AS (SELECT unnest([5, 10, 20]) AS k),
    hits AS (SELECT k, user_id, rank, gain, row_number() OVER (PARTITION BY k, user_id ORDER BY rank) AS nth
             FROM ranked JOIN gains USING (user_id, item), ks WHERE rank <= k),
    mine AS (SELECT k, user_id, COUNT(*) AS hits, SUM(nth / rank) AS ps, SUM(gain / log2(rank + 1)) AS dcg FROM hits GROUP BY 1, 2),
    best AS (SELECT k, user_id, COUNT(*) AS relevant, SUM(gain / log2(place + 1)) FILTER (place <= k) AS idcg
             FROM ideal, ks GROUP BY 1, 2)
    SELECT k, COUNT(*) AS users, round(AVG(coalesce(hits, 0) / k), 6) AS precision, round(AVG(coalesce(hits, 0) / relevant), 6) AS recall,
           round(AVG(coalesce(ps, 0) / least(relevant, k)), 6) AS map, round(AVG(coalesce(dcg, 0) / idcg), 6) AS ndcg
    FROM best LEFT JOIN mine USING (k, user_id) GROUP BY k"""
_SPENT = """
    WITH spent AS (SELECT user_id, CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS c FROM events GROUP BY 1),
    ranked AS (SELECT c, row_number() OVER w AS rank, SUM(c) OVER w AS running, COUNT(*) OVER () AS n, SUM(c) OVER () AS total
               FROM spent WINDOW w AS (ORDER BY c, user_id ROWS UNBOUNDED PRECEDING))"""
ORACLES["concentration_curve"] = _SPENT + """,
    means AS (SELECT SUM(abs(a.c - b.c)) / (2.0 * COUNT(*) * AVG(a.c)) AS gini FROM spent a, spent b),
    points AS (SELECT unnest(range(1, 21)) AS point)
    SELECT CAST(point AS INT) AS point, rank AS rows, CAST(running AS BIGINT) AS total, round(running / total, 6) AS share, round(gini, 6) AS gini
    FROM points, ranked, means WHERE rank = (point * n + 19) // 20"""
ORACLES["top_shares"] = _SPENT + """
    SELECT part, greatest(1, CAST(floor(part * any_value(n)) AS BIGINT)) AS rows,
           round(SUM(c) FILTER (rank > n - greatest(1, floor(part * n))) / any_value(total), 6) AS share
    FROM ranked, (SELECT unnest([0.01::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE]) AS part) GROUP BY part"""

# -- large alias tables ------------------------------------------------------------------------------------

ORACLES["alias_places"] = f"""
    WITH names AS (SELECT DISTINCT unnest(list_concat(regexp_extract_all(lower(text), '[a-z]{{7,}}'),
                     regexp_extract_all(lower(text), '[a-z]+ [a-z]{{5,}}'), regexp_extract_all(lower(text), '[a-z]{{2}}[.,?]'))) AS alias
                   FROM benchmark),
    placed AS (SELECT alias, 'place ' || substr(alias, 1, 3) AS place FROM names),
    ranks AS (SELECT place, MIN(ascii(md5(place)) * 1000 + ascii(alias)) AS rank FROM placed GROUP BY 1),
    turns AS (SELECT conv_id, turn, lower(text) AS low FROM conversations WHERE NOT {_abroad("text")}),
    texts AS MATERIALIZED (SELECT DISTINCT low FROM turns),
    best AS (SELECT low, MIN((rank, place)) AS b FROM texts JOIN placed ON contains(low, alias) JOIN ranks USING (place) GROUP BY 1)
    SELECT conv_id, turn, b[2] AS place FROM turns JOIN best USING (low)"""
