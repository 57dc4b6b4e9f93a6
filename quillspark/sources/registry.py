"""The sources that evidence may come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import one_row
from .web import site_of

SCHEMA = "id string, name string, base_url string, enabled boolean"
DEFAULT = [(f"source{i}", f"Source {i}", f"https://source{i}.example.org/", i < 3) for i in range(6)]


def registry(spark: SparkSession, rows: list[tuple] = DEFAULT) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def discovered(pages: DataFrame, declared: DataFrame, url: str = "url", least: int = 1) -> DataFrame:
    """``declared`` and a source for every site that pages come from and no declared ``base_url`` names: its id and name are
    the site's host, and it is enabled if it has at least ``least`` pages. Pages are counted before they meet the registry."""
    sites = pages.groupBy(site_of(F.col(url)).alias("site")).agg(F.count("*").alias("n")).filter("site <> ''")
    taken = declared.select(site_of(F.col("base_url")).alias("site")).distinct()
    host = F.regexp_replace("site", "^.*://", "")
    fresh = sites.join(taken, "site", "left_anti")
    return declared.unionByName(fresh.select(F.col("site").alias("id"), host.alias("name"), F.concat("site", F.lit("/")).alias("base_url"), (F.col("n") >= least).alias("enabled")))


def enabled(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled")


def lookup(sources: DataFrame, source_id: str) -> dict:
    """Exactly one source, or KeyError."""
    return one_row(sources.filter(sources["id"] == source_id), source_id)
