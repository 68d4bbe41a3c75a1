"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelode.llm import docpairs
from codelode.sources import read_table, tables


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.documented(read_table(spark, sf, "symbols")).selectExpr("id as symbol_id")


def p1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.pairs(*tables(spark, sf, "symbols", "files", "file_blobs"))


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs}
SQL: dict[str, str] = {}
