"""Writing to the graph tables: upserts, replacement per file, cascading deletes, patches, packing.

Tables are written as whole new versions; every operator returns the new version as a frame."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """Rows of `existing` replaced by those of `incoming` of the same key; `keep` columns stay as they
    were (SNK-1..4). Both sides have the key once; both have the same columns."""
    old = existing.select(*key, F.struct(*existing.columns).alias("old"))
    new = incoming.select(*key, F.struct(*existing.columns).alias("new"))
    both = old.join(new, key, "full")
    pick = lambda c: F.when(F.col("new").isNull(), F.col(f"old.{c}")).when(F.col("old").isNotNull() & F.lit(c in keep), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c)
    return both.select(*[pick(c) for c in existing.columns])


def replace_per_parent(existing: DataFrame, batch: DataFrame, parent: str, changed: DataFrame) -> DataFrame:
    """All rows of the changed parents give way to the batch (SNK-5)."""
    return existing.join(changed.select(parent).distinct(), parent, "left_anti").select(*existing.columns).unionByName(batch.select(*existing.columns))


def delete_files(gone: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, vectors: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without the files of `gone` (id) and all that depends on them (SNK-7)."""
    ids = gone.select("id").distinct()
    by_file = ids.withColumnRenamed("id", "file_id")
    left = symbols.join(by_file, "file_id", "left_anti")
    lost = symbols.join(by_file, "file_id", "left_semi").select(F.col("id").alias("symbol_id")).distinct()
    return files.join(ids, "id", "left_anti"), left, edges.join(by_file, "file_id", "left_anti"), vectors.join(lost, "symbol_id", "left_anti")


def patch(existing: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fields of `changes` that are not null replace the old ones; unknown keys are no-ops (SNK-8)."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in columns])
    return existing.join(c, key, "left").select(*[F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in existing.columns])


def latest(runs: DataFrame) -> DataFrame:
    """The run of the greatest id (SNK-9)."""
    return runs.agg(F.max_by(F.struct(*runs.columns), "id").alias("r")).select("r.*")


#: A credential of a well-known form, which must not leave in a packed graph (own rules).
SECRET_FORMS = r"A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|glpat-[\w-]{18,}|xox[abeprs]-[\w-]{12,}|-----BEGIN [A-Z ]*PRIVATE KEY"


def leaking(symbols: DataFrame, memories: DataFrame, files: DataFrame) -> DataFrame:
    """(table_name, id) of rows whose text holds a credential (the gate of SNK-11)."""
    hit = lambda *cs: F.concat_ws(" ", *cs).rlike(SECRET_FORMS)
    s = symbols.where(hit("signature", "docstring")).select(F.lit("symbols").alias("table_name"), "id")
    m = memories.where(hit("title", "body")).select(F.lit("memories").alias("table_name"), "id")
    return s.unionByName(m).unionByName(files.where(hit("path")).select(F.lit("files").alias("table_name"), "id"))


def manifest(files: DataFrame, symbols: DataFrame, edges: DataFrame, memories: DataFrame) -> DataFrame:
    """One row: counts and the sorted languages (SNK-11)."""
    n = lambda df, c: df.agg(F.count("*").alias(c))
    f = files.agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    return f.crossJoin(F.broadcast(n(symbols, "symbols"))).crossJoin(F.broadcast(n(edges, "edges"))).crossJoin(F.broadcast(n(memories, "memories")))


def pack(folder: str, files: DataFrame, symbols: DataFrame, edges: DataFrame, memories: DataFrame) -> dict:
    """Writes the graph, zstd-compressed, with a manifest; refuses when any text holds a credential."""
    bad = leaking(symbols, memories, files).limit(1).collect()
    if bad:
        raise ValueError(f"a credential in {bad[0].table_name} {bad[0].id}: nothing is written")
    for name, df in (("files", files), ("symbols", symbols), ("edges", edges), ("memories", memories)):
        df.write.mode("overwrite").option("compression", "zstd").parquet(os.path.join(folder, f"{name}.parquet"))
    facts = manifest(files, symbols, edges, memories).first().asDict()
    files.sparkSession.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(folder, "manifest.json"))
    return facts


def unpack(spark, folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(os.path.join(folder, f"{n}.parquet")) for n in ("files", "symbols", "edges", "memories")}


def history(files: DataFrame, days: int = 90) -> DataFrame:
    """(path, last_commit, last_ms, churn) from a log of (path, commit, ms): churn counts the different
    commits of the last days before the newest entry (SRC-7)."""
    end = files.agg(F.max("ms").alias("end"))
    cut = F.col("end") - days * 86_400_000
    return files.crossJoin(F.broadcast(end)).groupBy("path").agg(F.max("ms").alias("last_ms"), F.countDistinct(F.when(F.col("ms") >= cut, F.col("commit"))).alias("churn"))


def pack_budget(ranked: DataFrame, budget: int, cap: int, most: int = 80) -> DataFrame:
    """Greedy packing of ranked items into a budget, per group (S-CAPS, WIN-4).

    ranked has (grp, place, item, full, skeleton, signature): the sizes of three renderings. Each
    item takes the first rendering that fits into min(rest, cap), or else its signature if that fits
    the rest, or is skipped. At most `most` items of a group are looked at, as a ranker gives them."""
    w = Window.partitionBy("grp").orderBy("place", "item")
    few = ranked.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    items = few.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("rn", "item", "full", "skeleton", "signature"))).alias("items"))
    taken = "array<struct<item:bigint,depth:string,tokens:bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(taken).alias("out"))

    def step(s, x):
        rest = F.lit(budget) - s["used"]
        room = F.least(rest, F.lit(cap))
        depth = F.when(x["full"] <= room, "full").when(x["skeleton"] <= room, "skeleton").when((x["signature"] <= room) | (x["signature"] <= rest), "signature")
        size = F.when(depth == "full", x["full"]).when(depth == "skeleton", x["skeleton"]).when(depth == "signature", x["signature"]).cast("bigint")
        add = (rest > 0) & depth.isNotNull()
        row = F.array(F.struct(x["item"].cast("bigint").alias("item"), depth.alias("depth"), size.alias("tokens"))).cast(taken)
        return F.struct((s["used"] + F.when(add, size).otherwise(0)).cast("bigint").alias("used"), F.when(add, F.concat(s["out"], row)).otherwise(s["out"]).alias("out"))

    folded = items.select("grp", F.aggregate("items", start, step, lambda s: s["out"]).alias("out"))
    return folded.select("grp", F.posexplode("out").alias("pos", "o")).select("grp", "pos", "o.item", "o.depth", "o.tokens")
