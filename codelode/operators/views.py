"""The current rows of the graph tables: repeats and superseded versions set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.sources import read_table


def newest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by `order`. The rank is limited before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def files(spark: SparkSession, sf: str) -> DataFrame:
    return newest(read_table(spark, sf, "files"), ["id"], ["updated_at", "ingested_at", "hash"])


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "symbols").distinct()


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "edges").distinct()


def memories(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "memories").distinct()


#: The same views for the oracle.
SQL = {
    "f": "f as (select * from files qualify row_number() over (partition by id order by updated_at desc nulls last, ingested_at desc nulls last, hash desc nulls last) = 1)",
    "s": "s as (select distinct * from symbols)",
    "e": "e as (select distinct * from edges)",
    "m": "m as (select distinct * from memories)",
}


def with_views(names: str, sql: str) -> str:
    return "with " + ", ".join(SQL[n] for n in names) + " " + sql
