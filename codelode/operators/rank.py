"""Hybrid ranking of symbols for a task: seven signals over one candidate set (S-RANK)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import text as t
from codelode.operators import graph as g
from codelode.operators import search
from codelode.operators.pagerank import personalized_pagerank
from codelode.session import cut

#: Default weights of the signals (fixed values).
WEIGHTS = {"lex": 0.25, "sem": 0.25, "graph": 0.25, "path": 0.1, "git": 0.075, "mem": 0.075, "note": 0.45}


def rank_for_task(task: str, files: DataFrame, symbols: DataFrame, edges: DataFrame, memories: DataFrame, semantic: DataFrame | None = None, weights: dict | None = None, limit: int = 40, pool: int = 40, notes: int = 10, rounds: int = 50) -> DataFrame:
    """(symbol_id, path, start_line, lex, sem, graph, path_score, git, mem, note, score, reasons), best first.

    semantic, if there is any, has (id, cosine) for the symbols of the active model. The candidates
    are the lexical and semantic hits, the symbols of hit files and of files that hit notes
    document, and one step of symbol edges around them; signals are scaled over the candidates."""
    spark, w = symbols.sparkSession, weights or WEIGHTS
    q = spark.createDataFrame([(0, task)], "query_id long, task string").select("query_id", F.explode(search.tokens(F.col("task"))).alias("term"))
    hit = lambda docs, text, k: search.top(search.bm25(docs, "id", text, q), "bm25", "id", k).withColumn("s", search.normalised_bm25()).select("id", "s")
    lex = cut(hit(symbols, F.concat_ws(" ", "name", "qualified_name", "signature", "docstring"), pool))
    file_hits = cut(hit(files, F.col("path"), pool).select(F.col("id").alias("file_id")))
    note_hits = hit(memories, F.concat_ws(" ", "title", "body", F.array_join("tags", " ")), notes)
    documents = edges.where("edge_type = 'documents' and source_type = 'memory' and target_type = 'file'").select(F.col("source_id").alias("id"), F.col("target_id").alias("file_id"), F.coalesce("confidence", F.lit(0.0)).alias("c"))
    fan = Window.partitionBy("id")
    note_files = documents.join(note_hits, "id").withColumn("n", F.count("*").over(fan)).groupBy("file_id").agg(F.max(F.col("s") * F.col("c") / F.sqrt("n")).alias("note"))
    top_note = note_files.agg(F.max("note")).first()[0] or 0.0
    note_files = cut(note_files.select("file_id", (F.col("note") / top_note if top_note > 0 else F.col("note")).alias("note")))
    empty = spark.createDataFrame([], "id long, cosine double")
    sem = semantic.select("id", "cosine") if semantic is not None else empty
    sem_top = cut(sem.orderBy(F.desc("cosine"), "id").limit(pool))
    seeds = lex.select("id").unionByName(sem_top.select("id")).unionByName(symbols.join(file_hits, "file_id", "left_semi").select("id")).unionByName(symbols.join(note_files, "file_id", "left_semi").select("id")).distinct()
    seeds = cut(seeds)
    candidates = cut(seeds.unionByName(g.neighbours(seeds, edges)).distinct().join(symbols.select("id"), "id", "left_semi"))
    teleport = (
        lex.select(F.concat(F.lit("s"), "id").alias("node"), F.col("s").alias("weight"))
        .unionByName(sem_top.select(F.concat(F.lit("s"), "id").alias("node"), F.col("cosine").alias("weight")))
        .unionByName(file_hits.select(F.concat(F.lit("f"), "file_id").alias("node"), F.lit(0.5).alias("weight")))
        .unionByName(note_files.select(F.concat(F.lit("f"), "file_id").alias("node"), F.col("note").alias("weight")))
    )
    nodes = symbols.select(F.concat(F.lit("s"), "id").alias("node")).unionByName(files.select(F.concat(F.lit("f"), "id").alias("node")))
    ranks = personalized_pagerank(nodes, g.ranking_edges(edges), teleport, most=rounds).where("node like 's%'").select(F.substring("node", 2, 30).cast("long").alias("id"), F.col("rank").alias("ppr"))
    strength = lex.select("id", F.col("s").alias("k")).unionByName(sem_top.select("id", F.col("cosine").alias("k"))).groupBy("id").agg(F.sum("k").alias("k"))
    strong = symbols.select("id", "file_id").join(strength.orderBy(F.desc("k"), "id").limit(8), "id").select("file_id").unionByName(note_files.orderBy(F.desc("note"), "file_id").limit(3).select("file_id"))
    # eleven paths at most
    near = files.select(F.col("id").alias("file_id"), F.col("path").alias("seed_path")).join(F.broadcast(strong.distinct()), "file_id", "left_semi").select("seed_path")
    mem = g.mentioned(symbols, files, memories).withColumn("mem", F.lit(1.0))
    date = F.coalesce(F.unix_millis(F.try_to_timestamp("git_last_date")), F.lit(0))
    place = files.select(F.col("id").alias("file_id"), "path", F.coalesce("git_churn", F.lit(0)).alias("churn"), date.alias("date"))
    rows = candidates.join(symbols.select("id", "file_id", "name", "start_line"), "id").join(place, "file_id").join(lex.withColumnRenamed("s", "lex"), "id", "left").join(sem.withColumnRenamed("cosine", "raw_sem"), "id", "left").join(ranks, "id", "left").join(mem, "id", "left").join(note_files, "file_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    rows = cut(rows.select("id", "name", "path", "start_line", "churn", "date", *[zero(c) for c in ("lex", "raw_sem", "ppr", "mem", "note")]))
    paths = rows.select("path").distinct().crossJoin(F.broadcast(near)).groupBy("path").agg(F.max(t.dir_overlap(F.col("path"), F.col("seed_path"))).alias("path_score"))
    scaled = (
        search.scaled(rows, {"sem": "raw_sem", "graph": "ppr", "recent": "date", "changed": "churn"})
        .join(paths, "path", "left")
        .withColumn("git", 0.5 * F.col("recent") + 0.5 * F.col("changed"))
        .withColumn("path_score", F.coalesce("path_score", F.lit(0.0)))
    )
    parts = {"lex": "lex", "sem": "sem", "graph": "graph", "path": "path_score", "git": "git", "mem": "mem", "note": "note"}
    score = F.round(sum((F.lit(w[k]) * F.col(c) for k, c in parts.items()), F.lit(0.0)), 6)
    reasons = F.array_compact(F.array(*[F.when(F.col(c) > least, F.lit(code)) for c, least, code in (("sem", 0.6, "semantic"), ("lex", 0.0, "lexical"), ("graph", 0.5, "central"), ("path_score", 0.5, "same_module"), ("mem", 0.0, "mentioned"), ("note", 0.0, "documented"))]))
    out = scaled.withColumn("score", score).withColumn("reasons", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("related"))))
    return out.orderBy(F.desc("score"), "path", "start_line", "id").limit(limit).select(F.col("id").alias("symbol_id"), "name", "path", "start_line", *[F.round(c, 6).alias(c) for c in parts.values()], "score", "reasons")
