"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import tokens
from codelode.sources import read_table


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_column(read_table(spark, sf, "documents"), "doc_id", "text")


def p7_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and tokens of the corpus per source."""
    n = tokens.encode_column(read_table(spark, sf, "documents"), "source", "text")
    return n.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.size("ids")).alias("tokens"))


QUERIES = {"p7_ids": p7_ids, "p7_totals": p7_totals}
SQL: dict[str, str] = {}
