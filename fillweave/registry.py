"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import queries as plans


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.cold_permutation(spark, sf_dir)


def queries():
    return dict(plans.QUERIES)


def oracle_sql():
    return dict(plans.SQL)
