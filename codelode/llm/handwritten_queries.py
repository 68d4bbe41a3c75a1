"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import handwritten as h
from codelode.sources import tables


#: Whose notice marks own work in the test tables.
OWNER = "meridian"


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return h.not_handwritten(*tables(spark, sf, "files", "file_blobs"), OWNER).select("file_id")


def p6_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """How many files are kept out, by reason."""
    return h.not_handwritten(*tables(spark, sf, "files", "file_blobs"), OWNER).groupBy("reason").agg(F.count("*").alias("files"))


QUERIES = {"p6_found": p6_found, "p6_reasons": p6_reasons}
SQL: dict[str, str] = {}
