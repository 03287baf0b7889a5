"""Demand and trend analytics against plain Python, on a skewed fixture; and the shape of the physical plans."""

import random
from collections import Counter
from datetime import date, datetime, timedelta
from itertools import combinations

import pytest

from checks.queries import QUERIES
from conftest import SMALL
from millrace.functions import words
from millrace.operators.filters import JobFilter, apply_filters
from millrace.plans import demand, trends
from millrace.schemas import JOB_SKILLS, SKILL_SNAPSHOTS
from millrace.sinks import tables as sinks

SKILLS = {f"s{i:02d}": ["LLM Stack", "Cloud", "Inference", "Healthcare"][i % 4] for i in range(25)}


@pytest.fixture(scope="module")
def world(spark):
    """Jobs of which one has every skill, one skill sits on nearly every job, and some have none."""
    rng = random.Random(11)
    jobs, links = [], []
    for i in range(300):
        low = rng.choice([None, 0, 60000, 60001, 90000, 1500000, rng.randint(50000, 300000)])
        high = None if low is None else rng.choice([None, 0, low + 10001])
        jobs.append((str(i), "lever", f"co{i % 7}", rng.choice(["Remote", "Austin"]), low, high,
                     rng.choice(["ML Engineer", "AI / ML"]), datetime(2024, 1, 1) + timedelta(hours=i % 50), i % 9 != 0))
        if i == 5:
            names = list(SKILLS)
        elif i % 10 == 3:
            names = []
        else:
            names = {"s00"} | set(rng.sample(list(SKILLS), rng.randint(0, 5)))
        links += [(str(i), "lever", n) for n in names]
    schema = ("external_id STRING, source STRING, company_name STRING, location_normalized STRING, salary_min INT, "
              "salary_max INT, role_category STRING, fetched_at TIMESTAMP, is_active BOOLEAN")
    skills = spark.createDataFrame([(n, c, "") for n, c in SKILLS.items()], "canonical_name STRING, category STRING, subcategory STRING")
    return jobs, links, (spark.createDataFrame(jobs, schema), spark.createDataFrame(links, JOB_SKILLS), skills)


def _active(jobs, links):
    kept = {j[0]: j for j in jobs if j[8]}
    return kept, [(k, n) for k, _, n in links if k in kept]


def _top(counter, n):
    return sorted(counter.items(), key=lambda kv: (-kv[1], kv[0]))[:n]


def test_frequency(world):
    jobs, links, frames = world
    kept, pairs = _active(jobs, links)
    expected = [(s, SKILLS[s], n, round(n / len(kept) * 100, 1)) for s, n in _top(Counter(s for _, s in pairs), 12)]
    got = [tuple(r) for r in demand.skill_frequency(*frames, top_n=12).collect()]
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert all(abs(g[3] - e[3]) < 0.051 for g, e in zip(got, expected))


def test_frequency_without_jobs(world):
    _, _, frames = world
    nobody = JobFilter(companies=["nobody"])
    assert demand.skill_frequency(*frames, nobody).count() == 0
    assert tuple(demand.skills_summary_stats(*frames[:2], nobody).first()) == (0, 0, 0, 0)
    assert demand.top_paying_skills(*frames, nobody).count() == 0


@pytest.mark.parametrize("bucket", [1, 1024, 10**9])
def test_top_paying_is_the_upper_median(world, monkeypatch, bucket):
    monkeypatch.setattr(demand, "BUCKET", bucket)
    jobs, links, frames = world
    kept, pairs = _active(jobs, links)
    pay = {}
    for k, s in pairs:
        low, high = kept[k][4], kept[k][5]
        if low is not None:
            pay.setdefault(s, []).append((low + (high or low)) / 2)
    rows = [(s, SKILLS[s], int(sorted(v)[len(v) // 2]), len(v)) for s, v in pay.items() if len(v) >= 3]
    expected = sorted(rows, key=lambda r: (-r[2], r[0]))[:15]
    assert [tuple(r) for r in demand.top_paying_skills(*frames, top_n=15, min_jobs=3).collect()] == expected


def test_combinations(world):
    jobs, links, frames = world
    _, pairs = _active(jobs, links)
    per_job = {}
    for k, s in pairs:
        per_job.setdefault(k, set()).add(s)
    counter = Counter(p for names in per_job.values() for p in combinations(sorted(names), 2))
    expected = [(*p, n) for p, n in _top(counter, 400) if n >= 2]
    got = demand.skill_combinations(frames[0], frames[1], top_n=400)
    assert [tuple(r) for r in got.collect()] == expected


def test_roadmap_stack_and_categories(world):
    _, _, frames = world
    freq = demand.skill_frequency(*frames, top_n=40).collect()
    by_category = {}
    for r in freq:
        by_category.setdefault(r["category"], []).append(r["skill"])
    known = [c for c in words.ROADMAP_ORDER if c in by_category]
    expected = [(i + 1, c, by_category[c]) for i, c in enumerate(known + [c for c in by_category if c not in known])]
    assert [tuple(r) for r in demand.study_roadmap(*frames).collect()] == expected
    stack = {(r["category"], r["skill"]) for r in demand.top_stack(*frames).collect()}
    assert stack == {(c, s) for c, n in words.STACK_QUOTA.items() for s in by_category.get(c, [])[:n]}


def test_summary(world):
    jobs, links, frames = world
    kept, pairs = _active(jobs, links)
    pays = [j[4] for j in kept.values() if j[4]]
    assert tuple(demand.skills_summary_stats(*frames[:2]).first()) == (
        len(kept), len({s for _, s in pairs}), int(sum(pays) / len(pays)), len({j[2] for j in kept.values()}))


def test_filters_together_and_wildcards(world):
    jobs, links, frames = world
    flt = JobFilter(min_salary=90000, locations=["Austin"], role_categories=["AI / ML"], skill="S_1")
    having = {k for k, _, s in links if s[0] == "s" and s[2] == "1"}
    expected = {j[0] for j in jobs if j[8] and j[3] == "Austin" and j[6] == "AI / ML" and j[0] in having
                and (j[4] is not None and (j[4] >= 90000 or (j[5] or 0) >= 90000))}
    assert {r["external_id"] for r in apply_filters(*frames[:2], flt).collect()} == expected
    literal = JobFilter(skill="s_1", skill_is_pattern=False)
    assert apply_filters(*frames[:2], literal).count() == 0


def test_matrix_and_feed(world):
    jobs, links, frames = world
    plain = frames[0].selectExpr("*", "'t' AS title", "'Senior' AS seniority", "location_normalized AS location",
                                 "false AS is_remote", "fetched_at AS posted_at", "external_id AS url")
    matrix = sinks.job_skill_matrix(plain, frames[1], frames[2])
    assert matrix.columns[10:] == [s for s, _ in _top(Counter(s for _, s in _active(jobs, links)[1]), 99)]
    row = matrix.filter("URL = '5'").first()
    assert all(row[s] == 1 for s in SKILLS)
    assert matrix.count() == len(_active(jobs, links)[0])
    feed = demand.job_feed(*frames, first=5, shown_skills=2).collect()
    assert len(feed) == 5 and all(len(r["shown"] or []) <= 2 for r in feed)


def test_bucketed_tables_join_without_a_shuffle(spark, world, tmp_path):
    _, _, frames = world
    expected = {tuple(r) for r in demand.skill_combinations(*frames[:2], top_n=500).collect()}
    for name, df in zip(("b_jobs", "b_links"), frames):
        sinks.write_bucketed(df, name, str(tmp_path / name), 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = demand.skill_combinations(spark.table("b_jobs"), spark.table("b_links"), top_n=500)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in pairs.collect()} == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in ("b_jobs", "b_links"):
            spark.sql(f"DROP TABLE {name}")
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(skill_a" in plan


def _snapshots(spark, *rows):
    return spark.createDataFrame([(date(2024, 1, d), s, n) for d, s, n in rows], SKILL_SNAPSHOTS)


def test_growth(spark, world):
    skills = world[2][2]
    snaps = _snapshots(spark, (1, "s00", 9), (8, "s00", 2), (8, "s01", 1), (8, "s02", 5), (9, "s03", 1),
                       (20, "s00", 4), (20, "s01", 9), (20, "s02", 5), (20, "s04", 3))
    got = [tuple(r) for r in trends.fastest_growing_skills(snaps, skills, date(2024, 1, 20), 15).collect()]
    assert got == [("s01", "Cloud", 1, 9, 8), ("s00", "LLM Stack", 2, 4, 2)]
    assert trends.fastest_growing_skills(snaps, skills, date(2024, 1, 20), 3).count() == 0
    assert trends.has_trend(trends.snapshot_span(snaps, date(2024, 1, 20), 3)).count() == 0
    assert trends.fastest_growing_skills(snaps, skills, date(2024, 3, 20), 3).count() == 0


def test_weeks_and_pivot(spark, world):
    skills = world[2][2]
    snaps = _snapshots(spark, (1, "s00", 1), (7, "s00", 2), (8, "s00", 4), (8, "s01", 7))
    weeks = {(r["week"], r["canonical_name"]): r["weekly_jobs"]
             for r in trends.weekly_snapshot_summary(snaps, skills, date(2024, 1, 31)).collect()}
    assert weeks == {("2024-01-01/2024-01-07", "s00"): 3, ("2024-01-08/2024-01-14", "s00"): 4,
                     ("2024-01-08/2024-01-14", "s01"): 7}
    pivot = trends.snapshot_pivot(snaps, skills, date(2024, 1, 31), 60)
    assert pivot.columns == ["canonical_name", "2024-01-01", "2024-01-07", "2024-01-08"]
    assert sorted(tuple(r) for r in pivot.collect()) == [("s00", 1.0, 2.0, 4.0), ("s01", 0.0, 0.0, 7.0)]


def test_window_prunes_partitions(spark, world, tmp_path):
    path = str(tmp_path / "s")
    trends.write_snapshot(_snapshots(spark, (1, "s00", 1), (8, "s00", 2)), path)
    trend = trends.skill_trend(spark.read.parquet(path), world[2][2], date(2024, 1, 10), 5)
    assert "PartitionFilters: [isnotnull(snapshot_date" in trend._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("stream_", "refresh_"))])
def test_plans_stay_in_the_jvm_without_nested_loops(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in ("PythonUDF", "EvalPython", "InPandas", "InArrow", "NestedLoop", "CartesianProduct"):
        assert bad not in plan
