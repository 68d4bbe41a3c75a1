"""Reading a tree of source files and notes with Spark's binary file source."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import notes as n
from codelode.functions import text as t

#: Files above this size are skipped.
MAX_BYTES = 512 * 1024
#: Folders that are never read (own list).
IGNORED_DIRS = (".git", "node_modules", "__pycache__", ".venv", "dist", "build", "coverage", ".cache")


def _glob(rule: str) -> str:
    """One gitignore-like glob as a regular expression: '**' spans folders, '*' and '?' do not."""
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and (end := rule.find("]", i + 2)) > 0:
            inner = rule[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return out


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether gitignore-like rules leave out a path relative to the root (SRC-3): the last rule that fits decides, '!'
    takes a file in again, but not out of a folder that is left out.

    A rule with a slash inside, or in front, is anchored; one with a slash behind means folders; a file
    in an ignored folder is ignored."""
    out, folders = F.lit(False), F.lit(False)
    for rule in rules:
        r = rule.strip()
        if not r or r.startswith("#"):
            continue
        keep, r = r.startswith("!"), r.removeprefix("!")
        folder, r = r.endswith("/"), r.rstrip("/")
        head = ("^" if "/" in r else "(?:^|.*/)") + _glob(r.lstrip("/"))
        if keep:
            out = F.when(path.rlike(head + "$"), False).otherwise(out)
            continue
        folders = folders | path.rlike(head + "/.*$")
        if not folder:
            out = F.when(path.rlike(head + "$"), True).otherwise(out)
    return folders | out


def walk(spark: SparkSession, root: str, ignore: list[str] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, size_bytes, modified_ms, content) of the regular files below `root` (SRC-1)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://") + "/"
    rel = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^file:/*" + re.escape(base.lstrip("/")), "")
    found = raw.select(rel.alias("path"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("modified_ms"), "content")
    return found.where(F.col("size_bytes") <= max_bytes).where(~ignored(F.col("path"), [f"{d}/" for d in IGNORED_DIRS] + list(ignore)))


def is_binary(content: Column) -> Column:
    """A NUL byte among the first 8,192 (FLT-8)."""
    return F.substring(content, 1, 8192).cast("string").contains("\u0000")


def source_files(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """Text files of known languages with hash, lines and test flag, as the table `files` has them."""
    raw = walk(spark, root, ignore).where(~is_binary(F.col("content")))
    text = F.decode("content", "UTF-8")
    return raw.select("path", t.language_of(F.col("path")).alias("language"), F.sha2("content", 256).alias("hash"), "size_bytes", t.line_count(text).alias("lines_count"), F.col("modified_ms").alias("last_modified"), t.is_test_path(F.col("path")).alias("is_test"), text.alias("content")).where("language != 'unknown'")


def notes(spark: SparkSession, root: str) -> DataFrame:
    """(path, title, body, section, refs) of the Markdown notes below `root`, dot entries left out (SRC-4, FN-4..7)."""
    raw = walk(spark, root).where(F.col("path").rlike(r"(?i)\.(md|markdown)$") & ~F.col("path").rlike(r"(^|/)\."))
    text = F.decode("content", "UTF-8")
    body = t.strip_frontmatter(text)
    section = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("")
    return raw.select("path", t.note_title(text, F.col("path")).alias("title"), body.alias("body"), section.alias("section"), t.code_refs(body).alias("refs"))


def agent_memories(spark: SparkSession, root: str) -> DataFrame:
    """Notes that lie directly in `root`, without indexes and examples, with their title and type (SRC-6, FN-6)."""
    raw = walk(spark, root).where(F.col("path").rlike(r"(?i)\.md$") & ~F.col("path").rlike(r"^\."))
    text = F.decode("content", "UTF-8")
    found = raw.select("path", n.memory_title(text, F.col("path")).alias("title"), n.memory_type(text, F.col("path")).alias("type"), t.strip_frontmatter(text).alias("body"))
    return found.where(~F.col("path").contains("/") & ~F.lower("path").rlike(r"^(memory|readme)\.md$|_example\.md$"))


def changed(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or whose hash differs (FLT-10)."""
    old = known.select(F.col("path").alias("_path"), F.col("hash").alias("_old"))
    return found.join(old, F.col("path") == F.col("_path"), "left").where("_old is null or _old != hash").drop("_path", "_old")


def vanished(found: DataFrame, known: DataFrame) -> DataFrame:
    """Known files that were not found any more (JN-16)."""
    seen = found.select(F.col("path").alias("_seen"))  # the two may come from one table
    return known.join(seen, F.col("path") == F.col("_seen"), "left_anti")
