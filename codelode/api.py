"""The verbs that a client asks: each gives a DataFrame of items over one graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.operators import capsule, extract, rank, search
from codelode.operators import graph as g
from codelode.operators import views as v
from codelode.session import cut

#: Types of notes that may be written.
NOTE_TYPES = ("architecture_decision", "bug_resolution", "project_convention", "known_issue", "failed_attempt", "agent_note")


class CodeGraph:
    """Read access to the tables of a folder, and new rows as frames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.files, self.symbols, self.edges, self.memories = (read(spark, folder) for read in (v.files, v.symbols, v.edges, v.memories))

    def resolve(self, target: str) -> DataFrame:
        """Symbols that a positive number (an id) or else an exact name means (FLT-6)."""
        if target.isdigit() and not target.startswith("0"):
            return self.symbols.where(F.col("id") == int(target))
        return self.symbols.where(F.col("name") == target)

    def search_code(self, query: str, limit: int = 15) -> DataFrame:
        return rank.rank_for_task(query, self.files, self.symbols, self.edges, self.memories, limit=limit)

    def find_symbol(self, name: str, kind: str | None = None) -> DataFrame:
        hits = self.symbols.where(F.col("name") == name)
        hits = hits.where(F.col("kind") == kind) if kind else hits
        return g.symbol_places(hits, self.files).orderBy("id")

    def callers(self, target: str) -> DataFrame:
        own = self.resolve(target).select(F.col("id").alias("target_id"))
        return g.edge_hits(self.edges.join(own, "target_id", "left_semi"), self.symbols, "source")

    find_references = callers

    def callees(self, target: str) -> DataFrame:
        own = self.resolve(target).select(F.col("id").alias("source_id"))
        return g.edge_hits(self.edges.join(own, "source_id", "left_semi"), self.symbols, "target")

    def impact(self, target: str) -> DataFrame:
        own = self.resolve(target).select("id")
        return g.impact(self.edges, self.symbols, self.files).join(own.withColumnRenamed("id", "symbol_id"), "symbol_id", "left_semi").groupBy("path").agg(F.min("why").alias("why"))

    def file_overview(self, path: str) -> DataFrame:
        """One row: the file with its symbols in line order, what it imports and what imports it."""
        f = self.files.where(F.col("path") == path).select("id", "path", "language")
        s = self.symbols.join(f.select(F.col("id").alias("file_id")), "file_id", "left_semi").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "name", "kind"))).alias("symbols"))
        i = g.imported_by(self.edges, self.files)
        out = i.where(F.col("importer") == path).agg(F.collect_set("imported").alias("imports"))
        back = i.where(F.col("imported") == path).agg(F.collect_set("importer").alias("imported_by"))
        return f.join(s, f.id == s.file_id, "left").drop("file_id").crossJoin(F.broadcast(out)).crossJoin(F.broadcast(back))

    def routes(self, pattern: str = "") -> DataFrame:
        """Routes by place of their files, those whose method or address holds the pattern (FLT-5)."""
        names = self.symbols.where("exported").groupBy("file_id").agg(F.collect_set("name").alias("names"))
        r = extract.routes(self.files, names)
        low = pattern.lower()
        return r.where(F.lower("address").contains(low) | F.lower("method").contains(low)) if low else r

    def architecture(self) -> DataFrame:
        """Files, symbols and importing edges per module, the largest first (S-ARCH)."""
        d = g.degrees(self.edges, self.symbols, self.files)
        return d.groupBy(g.module_of(F.col("path")).alias("module")).agg(F.count("*").alias("files"), F.sum("symbols").alias("symbols"), F.sum("importers").alias("importers")).orderBy(F.desc("symbols"), "module")

    def context_capsule(self, task: str, token_budget: int = 8000, blobs: DataFrame | None = None, family: str = "generic") -> dict[str, DataFrame]:
        """Files, tests and notes for a task, packed into the budget of tokens; blobs (file_id, content) has the texts."""
        ranked = rank.rank_for_task(task, self.files, self.symbols, self.edges, self.memories, limit=80)
        # eighty rows at most
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "start_line", "id")
        ranked = ranked.select(F.lit(0).cast("long").alias("query_id"), F.col("symbol_id").alias("id"), "path", "start_line", "score").withColumn("place", F.row_number().over(w)).select("query_id", "id", "place", "score")
        texts = blobs if blobs is not None else self.spark.createDataFrame([], "file_id long, content string")
        return capsule.capsules(self.spark.createDataFrame([(0, task)], "query_id long, task string"), cut(ranked), self.files, texts, self.symbols, self.edges, self.memories, token_budget, family)

    @staticmethod
    def log_capsule(logs: DataFrame, task: str, capsule_tokens: int, naive_estimate: int, tokenizer: str, model: str | None = None) -> DataFrame:
        """The log of capsules with one more (SNK-10)."""
        new = logs.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
        row = new.select("id", F.lit(task).alias("task"), F.lit(capsule_tokens).cast("long").alias("capsule_tokens"), F.lit(naive_estimate).cast("long").alias("naive_estimate"), F.lit(tokenizer).alias("tokenizer_used"), F.lit(model).cast("string").alias("model"), F.unix_millis(F.current_timestamp()).alias("created_at"))
        return logs.unionByName(row, allowMissingColumns=True)

    @staticmethod
    def token_stats(logs: DataFrame) -> DataFrame:
        """Capsules, their tokens, the naive cost, and what was saved of the totals, never less than 0 (AGG-1, NRM-10)."""
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return logs.agg(F.count("*").alias("capsules"), total("capsule_tokens").alias("capsule_tokens"), total("naive_estimate").alias("naive_estimate"), F.greatest(total("naive_estimate") - total("capsule_tokens"), F.lit(0)).alias("saved"))

    def team_memory(self, query: str, limit: int = 10) -> DataFrame:
        q = self.spark.createDataFrame([(0, query)], "query_id long, q string").select("query_id", F.explode(search.tokens(F.col("q"))).alias("term"))
        hits = search.top(search.bm25(self.memories, "id", F.concat_ws(" ", "title", "body", F.array_join("tags", " ")), q), "bm25", "id", limit)
        return hits.join(self.memories, "id").orderBy("place")

    def remember(self, note: str, kind: str = "agent_note", related_files: list[str] = ()) -> DataFrame:
        """The notes with one more; its title is the first line (SNK-6, FN-30)."""
        if kind not in NOTE_TYPES:
            raise ValueError(f"no such type of note: {kind}")
        new = self.memories.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
        text = F.lit(note)
        files = F.array(*[F.lit(p) for p in related_files]).cast("array<string>")
        none = F.array().cast("array<string>")
        now = F.unix_millis(F.current_timestamp())
        row = new.select("id", F.lit(kind).alias("type"), F.left(F.trim(F.substring_index(text, "\n", 1)), F.lit(80)).alias("title"), text.alias("body"), files.alias("related_files"), none.alias("related_symbols"), none.alias("tags"), F.lit("fresh").alias("stale_status"), now.alias("created_at"), now.alias("updated_at"))
        return self.memories.unionByName(row)
