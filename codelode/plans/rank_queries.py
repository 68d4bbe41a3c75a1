"""Hybrid ranking over the graph tables; iterative, so without SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelode.operators import rank
from codelode.operators import views as v
from codelode.sources import read_table


def srank_task(spark: SparkSession, sf: str) -> DataFrame:
    """The forty best symbols for the first evaluation task that an English note title names (S-RANK)."""
    m = v.memories(spark, sf)
    # one title is the query of this search
    task = m.where("size(related_files) > 0 and title rlike '[A-Za-z]{3}'").orderBy("id").select("title").first()
    return rank.rank_for_task(task.title if task else "", v.files(spark, sf), v.symbols(spark, sf), v.edges(spark, sf), m)


def srank_eval(spark: SparkSession, sf: str) -> DataFrame:
    """The best symbols for the question of the first evaluation task."""
    task = read_table(spark, sf, "eval_tasks").orderBy("task_id").select("task").first()
    return rank.rank_for_task(task.task if task else "", v.files(spark, sf), v.symbols(spark, sf), v.edges(spark, sf), v.memories(spark, sf))


QUERIES = {"srank_task": srank_task, "srank_eval": srank_eval}
SQL: dict[str, str] = {}
