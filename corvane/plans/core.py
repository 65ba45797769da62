"""Queries over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.operators import pricing_summary
from corvane.sources import read_table


def q_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing_summary(read_table(spark, sf_dir, "lineitem"))


QUERIES = {"pricing_summary": q_pricing_summary}

ORACLE_SQL = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(18,4)) AS revenue,
               count(*) AS n_lines
        FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
}
