"""Place aliases as a table: the join equals the single expression, on any aliases."""

import random

import pytest

from millrace.functions import places
from millrace.operators import places as by_join

ALIASES = "alias STRING, canonical STRING, ord INT"


def expected(texts, aliases):
    names = {}
    for alias, canonical, _ in sorted((a for a in aliases if None not in a and a[0]), key=lambda a: a[2]):
        names.setdefault(canonical, []).append(alias.lower())
    return {i: place for i, t in texts if t for place in [next((p for p, ns in names.items() if any(n in t.lower() for n in ns)), None)] if place}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_equals_the_first_place_in_order(spark, monkeypatch, seed):
    draw = random.Random(seed)
    letters = "abcdé "
    aliases = [("".join(draw.choice(letters) for _ in range(draw.randint(1, 7))), f"P{draw.randrange(25)}", k) for k in range(80)]
    aliases += [(None, "P1", 3), ("ab", None, 1), ("ab", "P9", None), ("", "P0", 0), ("ABC", "P3", 90)]
    texts = [(k, "".join(draw.choice(letters + "XYZ-") for _ in range(draw.choice([0, 1, 5, 40, 300])))) for k in range(200)]
    texts += [(1000 + k, texts[5][1]) for k in range(50)] + [(2000, None)]
    if seed > 1:
        monkeypatch.setattr(by_join, "CHUNK", 16)
    if seed > 2:
        monkeypatch.setattr(by_join, "is_small", lambda df: False)
    found = by_join.places_by_join(spark.createDataFrame(texts, "id INT, t STRING"), ["id"], "t", spark.createDataFrame(aliases, ALIASES))
    assert {r["id"]: r["place"] for r in found.collect()} == expected(texts, aliases)


def test_default_aliases_give_the_rule_of_the_expression(spark):
    texts = ["San Francisco, CA", "Remote - US", "Remote - Canada", "London", "NYC or Boston", "remote", "", None, "Remote - Tier 2", "Somewhere"]
    rows = [(a, place, 10 * k) for k, (place, names) in enumerate(places.words.LOCATION_ALIASES.items()) for a in names]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    found = {r["id"]: r["place"] for r in by_join.places_by_join(df, ["id"], "t", spark.createDataFrame(rows, ALIASES)).collect()}
    want = {r["id"]: r["p"] for r in df.select("id", places.normalize_location(df.t).alias("p")).collect() if r["p"]}
    assert found == want and len(want) >= 4


def test_no_aliases_and_no_texts(spark):
    none, one = spark.createDataFrame([], ALIASES), spark.createDataFrame([("austin", "Austin", 1)], ALIASES)
    texts = spark.createDataFrame([(1, "in Austin")], "id INT, t STRING")
    assert by_join.places_by_join(texts, ["id"], "t", none).collect() == []
    assert by_join.places_by_join(texts.limit(0), ["id"], "t", one).collect() == []
    assert [tuple(r) for r in by_join.places_by_join(texts, ["id"], "t", one).collect()] == [(1, "Austin")]
