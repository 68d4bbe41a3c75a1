"""Capsules of all evaluation tasks; token counts have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import capsule as c
from codelode.operators import search
from codelode.operators import views as v
from codelode.plans.text_queries import searched
from codelode.sources import read_table


def _capsules(spark, sf):
    tasks = read_table(spark, sf, "eval_tasks").select(F.col("task_id").alias("query_id"), "task")
    s = v.symbols(spark, sf).dropDuplicates(["id"])
    hits = searched(s, F.concat_ws(" ", "name", "qualified_name", "signature", "docstring"), read_table(spark, sf, "eval_tasks"), 80)
    ranked = hits.select("query_id", "id", "place", F.round(search.normalised_bm25(), 6).alias("score"))
    return c.capsules(tasks, ranked, v.files(spark, sf), read_table(spark, sf, "file_blobs"), s, v.edges(spark, sf), v.memories(spark, sf))


def capsule_files(spark, sf):
    """The files of each task's capsule, packed into 5,600 tokens (S-CAPS)."""
    return _capsules(spark, sf)["files"].drop("content")


def capsule_tests(spark, sf):
    return _capsules(spark, sf)["tests"]


def capsule_notes(spark, sf):
    return _capsules(spark, sf)["notes"]


QUERIES = {"scaps_files": capsule_files, "scaps_tests": capsule_tests, "scaps_notes": capsule_notes}
SQL: dict[str, str] = {}
