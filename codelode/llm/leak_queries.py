"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import leaks
from codelode.sources import tables


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(*tables(spark, sf, "documents", "eval_tasks"))


def p8_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents each leaked task stands in."""
    return p8_found(spark, sf).groupBy("task_id").agg(F.count("*").alias("documents"))


def p8_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that ask a passage again with other numbers or names."""
    return leaks.variants(*tables(spark, sf, "documents", "eval_tasks"))


QUERIES = {"p8_found": p8_found, "p8_tasks": p8_tasks, "p8_variants": p8_variants}
SQL: dict[str, str] = {}
