"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelode.llm import credentials as c
from codelode.sources import tables


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return c.lines(*tables(spark, sf, "files", "file_blobs"))


def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return c.redacted(*tables(spark, sf, "files", "file_blobs"))


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
SQL: dict[str, str] = {}
