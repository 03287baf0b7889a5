"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as driver
from checks.queries import QUERIES
from checks.compare import connect, differences
from conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    _, problems = differences(driver.queries()[name](spark, SMALL), duck, driver.oracle_sql()[name])
    assert not problems


def test_benchmark_dictionary_stays_distributed(spark, monkeypatch):
    frame = type(spark.range(1))

    def watched(self, collect=frame.collect):
        assert "canonical" not in self.columns, "the dictionary comes to the driver"
        return collect(self)

    monkeypatch.setattr(frame, "collect", watched)
    assert set(QUERIES["document_terms"](spark, SMALL).columns) == {"doc_id", "term"}
