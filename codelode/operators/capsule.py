"""Context capsules: ranked files, tests and notes of each task packed into a budget of tokens (S-CAPS).

All tasks are packed at once, a group per query_id; the only sequential steps, the folds over a
task's files and notes, run over the few that a ranker gives."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import notes as n
from codelode.functions import text as t
from codelode.functions import tokens as k
from codelode.operators import search
from codelode.session import cut

#: Parts of the budget for code, tests and notes, least cap of a file and of a note, weight of a documented file (fixed values).
CODE, TESTS, NOTES = 0.7, 0.15, 0.1
FILE_CAP, NOTE_CAP, EDGE = 600, 90, 5
DEPTHS = ("full", "excerpt", "skeleton", "signature")


def by_file(ranked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, file_id, score, hits): the best score of each file and its symbols in rank order (AGG-9).

    ranked has (query_id, id, place, score); place is the rank of a symbol in its query."""
    s = symbols.select("id", "file_id", "name", "qualified_name", "kind", "signature", "start_line", "end_line")
    hit = F.struct("place", "id", "name", "qualified_name", "signature", "start_line", "end_line")
    return ranked.join(s, "id").groupBy("query_id", "file_id").agg(F.max("score").alias("score"), F.array_sort(F.collect_list(hit)).alias("hits"))


def fenced(lang: Column, text: Column) -> Column:
    return F.concat(F.lit("```"), lang, F.lit("\n"), text, F.lit("\n```"))


def excerpt(content: Column, hits: Column) -> Column:
    """The lines of the first four symbols, each range once, clipped to the file (FN-20)."""
    lines = F.split(content, "\n")
    ranges = F.array_distinct(F.transform(F.slice(hits, 1, 4), lambda h: F.struct(F.greatest(h["start_line"], F.lit(1)).alias("a"), F.least(h["end_line"], F.size(lines)).alias("b"))))
    return F.array_join(F.transform(F.filter(ranges, lambda r: r["b"] >= r["a"]), lambda r: F.array_join(F.slice(lines, r["a"], r["b"] - r["a"] + 1), "\n")), "\n\n")


def skeletons(symbols: DataFrame) -> DataFrame:
    """(file_id, outline): signatures in line order, each behind its documentation, 120 characters of it (FN-20)."""
    sig = F.coalesce(F.when(F.col("signature") != "", F.col("signature")), F.concat_ws(" ", "kind", "name"))
    line = F.concat(F.when(F.coalesce("docstring", F.lit("")) != "", F.concat(F.lit("// "), F.left("docstring", F.lit(120)), F.lit("\n"))).otherwise(""), F.when(sig.contains("("), F.concat(sig, F.lit(" { /* … */ }"))).otherwise(sig))
    rows = symbols.select("file_id", F.struct("start_line", "id", line.alias("line")).alias("r"))
    return rows.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("outline"))


def signatures(hits: Column) -> Column:
    """The first eight symbols of a file (FN-20, TOP-6)."""
    return F.array_join(F.transform(F.slice(hits, 1, 8), lambda h: F.concat(F.lit("- `"), F.coalesce(F.when(h["signature"] != "", h["signature"]), h["name"]), F.lit("` ("), h["qualified_name"], F.lit(")"))), "\n")


def renderings(files_of: DataFrame, files: DataFrame, blobs: DataFrame, symbols: DataFrame, family: str) -> DataFrame:
    """The four renderings of each ranked file with their tokens; a file with secrets or without text has neither the
    full text nor an excerpt."""
    wanted = files_of.select("file_id").distinct()
    place = files.select(F.col("id").alias("file_id"), "path", n.fence_lang(F.col("language")).alias("lang"), F.coalesce("has_secrets", F.lit(False)).alias("secret"))
    text = blobs.select("file_id", "content").join(wanted, "file_id", "left_semi").groupBy("file_id").agg(F.max("content").alias("content"))
    outline = skeletons(symbols.join(wanted, "file_id", "left_semi"))
    x = files_of.join(place, "file_id").join(text, "file_id", "left").join(outline, "file_id", "left")
    open_ = ~F.col("secret") & (F.coalesce("content", F.lit("")) != "")
    x = x.select(
        "query_id", "file_id", "path", "score", F.get("hits", F.lit(0))["qualified_name"].alias("symbol"),
        F.when(open_, fenced(F.col("lang"), F.regexp_replace("content", r"\s+$", ""))).alias("full"),
        F.when(open_, fenced(F.col("lang"), excerpt(F.col("content"), F.col("hits")))).alias("excerpt"),
        fenced(F.col("lang"), F.concat_ws("\n", F.concat(F.lit("// "), F.col("path")), "outline")).alias("skeleton"),
        signatures(F.col("hits")).alias("signature"),
    )
    return x.select("*", *[F.when(F.col(d).isNotNull(), k.token_count(F.col(d), family)).alias(f"{d}_tokens") for d in DEPTHS])


def packed(rendered: DataFrame, budget: int) -> DataFrame:
    """(query_id, pos, file_id, path, symbol, score, depth, tokens, content): the files of each task, best first, in the first
    rendering that fits into min(rest, cap), else in signatures if those fit the rest, else not (WIN-4, NRM-12)."""
    cap = max(FILE_CAP, budget // 2)
    order = F.struct((-F.col("score")).alias("place"), "path", "file_id", *[f"{d}_tokens" for d in DEPTHS])
    items = rendered.groupBy("query_id").agg(F.array_sort(F.collect_list(order)).alias("items"))
    taken = "array<struct<file_id:bigint,depth:string,tokens:int>>"

    def step(s, x):
        rest = F.lit(budget) - s["used"]
        depth, size = F.lit(None).cast("string"), F.lit(None).cast("int")
        for d in reversed(DEPTHS):
            room = F.least(rest, F.lit(cap)) if d != "signature" else rest
            fits = x[f"{d}_tokens"] <= room
            depth, size = F.when(fits, F.lit(d)).otherwise(depth), F.when(fits, x[f"{d}_tokens"]).otherwise(size)
        add = (rest > 0) & depth.isNotNull()
        row = F.array(F.struct(x["file_id"].alias("file_id"), depth.alias("depth"), size.alias("tokens"))).cast(taken)
        return F.struct((s["used"] + F.when(add, size).otherwise(0)).cast("int").alias("used"), F.when(add, F.concat(s["out"], row)).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("int").alias("used"), F.array().cast(taken).alias("out"))
    chosen = items.select("query_id", F.posexplode(F.aggregate("items", start, step, lambda s: s["out"])).alias("pos", "o")).select("query_id", "pos", "o.file_id", "o.depth", "o.tokens")
    content = F.coalesce(*[F.when(F.col("depth") == d, F.col(d)) for d in DEPTHS])
    return chosen.join(rendered, ["query_id", "file_id"]).select("query_id", "pos", "file_id", "path", "symbol", "score", "depth", "tokens", content.alias("content"))


def related_tests(chosen: DataFrame, symbols: DataFrame, edges: DataFrame, files: DataFrame, budget: int, family: str) -> DataFrame:
    """(query_id, place, path): test files of the symbols of the packed files, up to the first that overflows (WIN-5)."""
    tested = edges.where("edge_type = 'tested_by' and source_type = 'symbol' and target_type = 'file'").select(F.col("source_id").alias("id"), F.col("target_id").alias("test_id"), F.col("id").alias("edge_id"))
    met = chosen.select("query_id", "pos", "file_id").join(symbols.select("id", "file_id", "start_line"), "file_id").join(tested, "id").join(files.select(F.col("id").alias("test_id"), "path"), "test_id")
    first = met.groupBy("query_id", "path").agg(F.min(F.struct("pos", "start_line", "id", "edge_id")).alias("first"))
    w = Window.partitionBy("query_id").orderBy("first", "path")
    rows = first.withColumn("tokens", k.token_count(F.concat(F.lit("- "), F.col("path")), family)).withColumn("used", F.sum("tokens").over(w)).withColumn("place", F.row_number().over(w))
    return rows.where(F.col("used") <= budget).select("query_id", "place", "path", "tokens")


def code_terms(tasks: DataFrame, ranked: DataFrame, symbols: DataFrame, files: DataFrame, most: int = 12) -> DataFrame:
    """(query_id, terms): the first words of the ten best symbols and their files that the task does not have (FN-24)."""
    top = ranked.where("place <= 10").join(symbols.select("id", "file_id", "name"), "id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    words = top.select("query_id", F.struct("place", "id", t.subtokenize(F.substring_index("path", "/", -1), F.col("name")).alias("w")).alias("r"))
    lists = words.groupBy("query_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["w"]))).alias("w"))
    own = tasks.select("query_id", t.subtokenize(F.col("task")).alias("have"))
    return own.join(lists, "query_id", "left").select("query_id", F.slice(F.filter(F.coalesce("w", F.array().cast("array<string>")), lambda x: (F.length(x) >= 3) & ~F.array_contains("have", x)), 1, most).alias("terms"))


def scored_notes(tasks: DataFrame, terms: DataFrame, chosen: DataFrame, memories: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, id, score, fts): notes found by the task and the code's terms, weighted by section and title, and notes that
    document packed files, with five points a file for each place from the end (SET-4, WIN-6, FN-27)."""
    asked = tasks.join(terms, "query_id").select("query_id", F.concat_ws(" ", F.col("task"), F.array_join("terms", " ")).alias("q"))
    words = asked.select("query_id", F.explode(search.tokens(F.col("q"))).alias("term"))
    hits = search.top(search.bm25(memories, "id", F.concat_ws(" ", "title", "body", F.array_join("tags", " ")), words).withColumn("bm25", F.round("bm25", 9)), "bm25", "id", 30)
    rows = hits.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).join(memories.select("id", "title", "tags", "type"), "id").join(asked.select("query_id", t.subtokenize(F.col("q")).alias("qw")), "query_id")
    factor = F.when(F.col("type").isin("second_brain", "generated_brain"), t.section_weight(F.col("tags")) * t.title_boost(F.col("title"), F.col("qw"))).otherwise(1.0)
    lexical = rows.select("query_id", "id", ((F.col("n") - F.col("place") + 1) * factor).alias("score"), F.col("place").alias("fts"))
    documents = edges.where("edge_type = 'documents' and source_type = 'memory' and target_type = 'file'").select(F.col("source_id").alias("id"), F.col("target_id").alias("file_id"))
    size = chosen.groupBy("query_id").agg(F.count("*").alias("n"))
    bonus = chosen.select("query_id", "pos", "file_id").join(size, "query_id").join(documents, "file_id").select("query_id", "id", (F.lit(float(EDGE)) * (F.col("n") - F.col("pos"))).alias("score"), F.lit(None).cast("int").alias("fts"))
    return lexical.unionByName(bonus.join(memories.select("id"), "id", "left_semi")).groupBy("query_id", "id").agg(F.sum("score").alias("score"), F.min("fts").alias("fts"))


def render_note(header: str, snippet: str, cap: int, family: str) -> tuple[str, int] | None:
    """The note with as much of its snippet as the cap allows; None if not even the header fits (FN-9)."""
    text = f"{header} — {snippet}" if snippet else header
    size = k.count(text, family)
    if size > cap:
        lo, hi = 0, len(snippet)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if k.count(f"{header} — {snippet[:mid]}…", family) <= cap else (lo, mid - 1)
        text = f"{header} — {snippet[:lo]}…" if lo else header
        size = k.count(text, family)
    return (text, size) if size <= cap else None


def packed_notes(tasks: DataFrame, scored: DataFrame, memories: DataFrame, budget: int, family: str) -> DataFrame:
    """(query_id, place, id, tokens, text): notes of each task, best first, each cut to its cap, until the budget is used
    (TOP-5); what does not fit is passed over."""
    cap = max(NOTE_CAP, budget // 6)
    path = F.when(F.col("type").isin("second_brain", "generated_brain"), F.get("tags", F.lit(0)))
    stale = F.when(F.col("stale_status") == "stale", "⚠ possibly outdated — ").otherwise("")
    header = F.concat(stale, F.when(path.isNotNull(), F.concat(F.lit("["), path, F.lit("] "))).otherwise(""), F.col("title"))
    rows = scored.join(memories.dropDuplicates(["id"]).select("id", "type", "title", "body", "tags", "stale_status"), "id").join(tasks.select("query_id", "task"), "query_id")
    rows = rows.select("query_id", "id", "score", "fts", header.alias("header"), t.snippet(F.col("body"), F.col("task")).alias("snippet"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "fts", "id"], ascending=[False, True, True], na_position="last")
        used, out = 0, []
        for r in pdf.itertuples():
            if used >= budget:
                break
            if got := render_note(r.header or "", r.snippet or "", min(cap, budget - used), family):
                out.append((r.query_id, len(out) + 1, r.id, got[1], got[0]))
                used += got[1]
        return pd.DataFrame(out, columns=["query_id", "place", "id", "tokens", "text"])

    return rows.groupBy("query_id").applyInPandas(fold, "query_id long, place int, id long, tokens int, text string")


def capsules(tasks: DataFrame, ranked: DataFrame, files: DataFrame, blobs: DataFrame, symbols: DataFrame, edges: DataFrame, memories: DataFrame, budget: int = 8000, family: str = "generic") -> dict[str, DataFrame]:
    """files, tests and notes of the capsule of each task (query_id, task), from its ranked symbols (query_id, id, place, score)."""
    chosen = cut(packed(renderings(by_file(ranked, symbols), files, blobs, symbols, family), int(budget * CODE)))
    notes = scored_notes(tasks, code_terms(tasks, ranked, symbols, files), chosen, memories, edges)
    return {
        "files": chosen,
        "tests": related_tests(chosen, symbols, edges, files, int(budget * TESTS), family),
        "notes": packed_notes(tasks, notes, memories, int(budget * NOTES), family),
    }
