"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelode.llm import neighbours as n
from codelode.sources import read_table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return n.similar_pairs(read_table(spark, sf, "symbol_vectors"))


def p3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar vectors of every usable vector."""
    return n.neighbours(read_table(spark, sf, "symbol_vectors")).selectExpr("model_id", "a as symbol_id", "b as neighbour_id", "round(cosine, 6) as cosine", "place")


def p3_search(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar vectors of every symbol divisible by 20, by greedy search over the graph of all."""
    return n.searched(read_table(spark, sf, "symbol_vectors"), "id % 20 = 0").selectExpr("model_id", "symbol_id", "neighbour_id", "round(cosine, 6) as cosine", "place")


def p3_recall(spark: SparkSession, sf: str) -> DataFrame:
    """What share of the exact five the graph of all vectors has, for the symbols divisible by 20."""
    v = read_table(spark, sf, "symbol_vectors")
    found = n.neighbours(v).where("a % 20 = 0").selectExpr("model_id", "a as symbol_id", "b as neighbour_id", "cosine")
    return n.recall(found, v, "symbol_id % 20 = 0")


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_search": p3_search, "p3_recall": p3_recall}
SQL: dict[str, str] = {}
