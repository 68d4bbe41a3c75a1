"""Lookups, joins and roll-ups over the typed graph of files, symbols and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calls(edges: DataFrame) -> DataFrame:
    return edges.where("edge_type = 'calls' and source_type = 'symbol' and target_type = 'symbol'")


def imports(edges: DataFrame) -> DataFrame:
    return edges.where("edge_type = 'imports' and source_type = 'file' and target_type = 'file'")


def symbol_places(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with the path of their file, '?' where the file is unknown (JN-2)."""
    p = files.select(F.col("id").alias("file_id"), "path")
    return symbols.join(p, "file_id", "left").withColumn("path", F.coalesce("path", F.lit("?")))


def edge_hits(edges: DataFrame, symbols: DataFrame, end: str) -> DataFrame:
    """For every symbol its callers (end = source) or callees (end = target), each once: the most
    confident edge wins, then the earliest (JN-3, AGG-3). Edges without both ends are dropped."""
    other = {"source": "target", "target": "source"}[end]
    known = symbols.select(F.col("id").alias("hit_id"), F.col("name").alias("hit_name"))
    own = symbols.select(F.col("id").alias("symbol_id"))
    hits = calls(edges).select(F.col(f"{other}_id").alias("symbol_id"), F.col(f"{end}_id").alias("hit_id"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("id").alias("edge_id"))
    best = Window.partitionBy("symbol_id", "hit_id").orderBy(F.desc("confidence"), "edge_id")
    one = hits.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")
    return one.join(known, "hit_id").join(own, "symbol_id", "left_semi")


def imported_by(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Importer and imported path of every import edge, not de-duplicated (JN-4)."""
    a, b = files.select(F.col("id").alias("source_id"), F.col("path").alias("importer")), files.select(F.col("id").alias("target_id"), F.col("path").alias("imported"))
    return imports(edges).join(a, "source_id").join(b, "target_id").select(F.col("id").alias("edge_id"), "importer", "imported")


def impact(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """For every symbol: the files that import its file, its test files and the files of its callers,
    each path once with the first reason found (JN-5)."""
    place = symbols.select(F.col("id").alias("symbol_id"), "file_id")
    path = files.select(F.col("id").alias("hit_file"), "path")
    importers = place.join(imports(edges).select(F.col("target_id").alias("file_id"), F.col("source_id").alias("hit_file")), "file_id").select("symbol_id", "hit_file", F.lit(1).alias("why"))
    tests = edges.where("edge_type = 'tested_by' and source_type = 'symbol' and target_type = 'file'").select(F.col("source_id").alias("symbol_id"), F.col("target_id").alias("hit_file"), F.lit(2).alias("why")).join(place.select("symbol_id"), "symbol_id", "left_semi")
    callers = calls(edges).select(F.col("target_id").alias("symbol_id"), F.col("source_id").alias("id")).join(symbols.select("id", F.col("file_id").alias("hit_file")), "id").select("symbol_id", "hit_file", F.lit(3).alias("why")).join(place.select("symbol_id"), "symbol_id", "left_semi")
    every = importers.unionByName(tests).unionByName(callers).groupBy("symbol_id", "hit_file").agg(F.min("why").alias("why"))
    return every.join(path, "hit_file").select("symbol_id", "path", "why")


def degrees(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols and importing edges per file (AGG-6)."""
    s = symbols.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("symbols"))
    i = imports(edges).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("importers"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return files.select("id", "path", "language").join(s, "id", "left").join(i, "id", "left").select("id", "path", "language", zero("symbols"), zero("importers"))


def module_of(path: Column) -> Column:
    """The module of a path: one segment past the last container folder, two at least (FN-17)."""
    seg = F.split(path, "/")
    n = F.size(seg)
    last = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda acc, i: F.when(F.lower(F.element_at(seg, i)).isin(*CONTAINERS), i).otherwise(acc))
    cut = F.when(last > 0, F.least(n - 1, last + 1)).otherwise(F.lit(2))
    return F.when(n == 1, "(root)").when(n == 2, seg[0]).otherwise(F.array_join(F.slice(seg, 1, F.greatest(cut, F.lit(1))), "/"))


#: Folder names that hold modules (fixed values).
CONTAINERS = ("modules", "packages", "lib", "src", "app", "features", "services")


def enclosing(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """The innermost symbol around each line of a file: the greatest start, ties by id (JN-8).

    lines has (file_id, line) and more; an equi-join on the file with a range condition."""
    s = symbols.select("file_id", F.col("id").alias("symbol_id"), "start_line", "end_line")
    met = lines.join(s, "file_id").where("start_line <= line and line <= end_line")
    best = Window.partitionBy("file_id", "line").orderBy(F.desc("start_line"), "symbol_id")
    return met.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("file_id", "line", "symbol_id")


def resolve_names(references: DataFrame, symbols: DataFrame, first: int = 5) -> DataFrame:
    """Targets of named references: callable symbols of that name, or else any, the first five by
    id; the number of candidates says how sure the match is (JN-7)."""
    wanted = references.select("name").distinct()
    s = symbols.join(wanted, "name", "left_semi").select("name", F.col("id").alias("target_id"), F.when(F.col("kind").isin("function", "method", "class"), 0).otherwise(1).alias("rank"))
    least = s.groupBy("name").agg(F.min("rank").alias("rank"))
    pick = s.join(least, ["name", "rank"])
    w = Window.partitionBy("name").orderBy("target_id")
    counted = pick.groupBy("name").agg(F.count("*").alias("candidates"))
    top = pick.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first).join(counted, "name")
    return references.join(top.select("name", "target_id", "candidates"), "name").withColumn("confidence", F.when(F.col("candidates") == 1, 0.7).otherwise(0.4))


def resolve_calls(references: DataFrame, symbols: DataFrame, imported: DataFrame, first: int = 5) -> DataFrame:
    """(caller_id, name, target_id, confidence) of named calls (caller_id, name): the first five targets of the name,
    0.85 where the caller's file imports the target's; the caller itself is left out after the cut (JN-7).

    imported has (file_id, target_file), each pair once."""
    place = symbols.groupBy("id").agg(F.min("file_id").alias("file_id"))
    one = symbols.select("id", "name", "kind").distinct()
    found = resolve_names(references, one, first).where("caller_id != target_id")
    found = found.join(place.select(F.col("id").alias("caller_id"), "file_id"), "caller_id").join(place.select(F.col("id").alias("target_id"), F.col("file_id").alias("target_file")), "target_id")
    known = imported.withColumn("known", F.lit(True))
    return found.join(known, ["file_id", "target_file"], "left").withColumn("confidence", F.when(F.col("known"), 0.85).otherwise(F.col("confidence")))


def suffixes(files: DataFrame) -> DataFrame:
    """Every '/'-suffix of every path, so that a suffix match is an equi-join (JN-10)."""
    seg = F.split("path", "/")
    each = files.select(F.col("id").alias("file_id"), "path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(seg)), lambda i: F.array_join(F.slice(seg, i, F.size(seg)), "/"))).alias("cut", "suffix"))
    return each.select("file_id", "suffix", (F.col("cut") == 0).alias("whole"))


def note_links(memories: DataFrame, files: DataFrame) -> DataFrame:
    """note -> file links: the exact path (1.0), or else the first file, by id, whose path ends with a
    reference that holds a '/' (0.8); one link per note and file (S-LINK)."""
    refs = memories.select(F.col("id").alias("memory_id"), F.explode(F.array_distinct("related_files")).alias("suffix")).where("suffix is not null")
    one = refs.join(suffixes(files), "suffix").where("whole or instr(suffix, '/') > 0").groupBy("memory_id", "suffix").agg(F.min(F.struct((~F.col("whole")).alias("partial"), "file_id")).alias("m"))
    return one.groupBy("memory_id", F.col("m.file_id").alias("file_id")).agg(F.max(F.when(F.col("m.partial"), 0.8).otherwise(1.0)).alias("confidence"))


def dead_references(memories: DataFrame, files: DataFrame) -> DataFrame:
    """References of notes, with a '/', to paths that no file has or ends with (JN-11)."""
    refs = memories.select(F.col("id").alias("memory_id"), F.explode(F.array_distinct("related_files")).alias("suffix")).where("instr(suffix, '/') > 0")
    return refs.join(suffixes(files).select("suffix").distinct(), "suffix", "left_anti").select("memory_id", F.col("suffix").alias("ref"))


def mentioned(symbols: DataFrame, files: DataFrame, memories: DataFrame) -> DataFrame:
    """Symbols that a note names by file path, qualified name or name: three semi-joins (JN-12)."""
    paths = memories.select(F.explode("related_files").alias("path")).distinct()
    names = memories.select(F.explode("related_symbols").alias("n")).distinct()
    by_file = symbols.join(files.join(paths, "path", "left_semi").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    by_name = symbols.join(names.withColumnRenamed("n", "name"), "name", "left_semi")
    by_full = symbols.join(names.withColumnRenamed("n", "qualified_name"), "qualified_name", "left_semi")
    return by_file.select("id").unionByName(by_name.select("id")).unionByName(by_full.select("id")).distinct()


def neighbours(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The symbols one call or other symbol edge away from the seeds, in either direction (JN-14)."""
    e = edges.where("source_type = 'symbol' and target_type = 'symbol'").select("source_id", "target_id")
    out = e.join(seeds.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    back = e.join(seeds.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id"))
    return out.unionByName(back).distinct()


def ranking_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of the ranking graph: symbols and files only, weight at least 0.05, every
    defines edge also backwards at 0.5; parallel edges are summed (SET-2)."""
    code = {"symbol": "s", "file": "f"}
    node = lambda t, i: F.concat(F.when(F.col(t) == "symbol", code["symbol"]).otherwise(code["file"]), F.col(i).cast("string"))
    e = edges.where("source_type in ('symbol', 'file') and target_type in ('symbol', 'file')")
    fwd = e.select(node("source_type", "source_id").alias("src"), node("target_type", "target_id").alias("dst"), F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.05)).alias("weight"))
    back = e.where("edge_type = 'defines'").select(node("target_type", "target_id").alias("src"), node("source_type", "source_id").alias("dst"), F.lit(0.5).alias("weight"))
    return fwd.unionByName(back).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
