"""Company registry, skill dictionary, hierarchy and alias tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators.matching import prepare_dictionary

KNOWN_SOURCES = ["greenhouse", "lever", "ashby", "workday"]


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header `name,ats_type,slug,career_url`."""
    return spark.read.schema(schemas.REGISTRY).option("header", True).csv(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary file, one JSON object per line: key, aliases, canonical, category, subcategory, ord."""
    schema = (
        "key STRING, aliases ARRAY<STRING>, canonical STRING, category STRING, subcategory STRING, ord INT"
    )
    return prepare_dictionary(spark.read.schema(schema).json(path))


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header `parent,child`."""
    return spark.read.schema(schemas.SKILL_HIERARCHY).option("header", True).csv(path)


def read_location_aliases(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header `alias,canonical,ord`."""
    return spark.read.schema(schemas.LOCATION_ALIASES).option("header", True).csv(path)


def known_companies(registry: DataFrame) -> DataFrame:
    """Companies whose source has a normaliser."""
    return registry.filter(F.col("ats_type").isin(KNOWN_SOURCES))


def unknown_companies(registry: DataFrame) -> DataFrame:
    """Companies with any other source, reported with nothing stored and nothing skipped."""
    unknown = ~F.coalesce(F.col("ats_type").isin(KNOWN_SOURCES), F.lit(False))
    return registry.filter(unknown).select(
        "name", "ats_type", F.lit(0).cast("bigint").alias("stored"), F.lit(0).cast("bigint").alias("skipped")
    )


def with_company(landed: DataFrame, registry: DataFrame) -> DataFrame:
    """Give landed payloads `(slug, ...)` their company name and source."""
    companies = known_companies(registry).select(
        "slug", F.col("name").alias("company_name"), F.col("ats_type").alias("source")
    )
    return landed.join(companies, "slug")
