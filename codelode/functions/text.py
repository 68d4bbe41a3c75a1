"""Text functions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subtokenize(*parts: Column) -> Column:
    """The different lower-case words of names, glued names taken apart, in order (FN-1)."""
    text = F.concat_ws(" ", *parts)
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    split = lambda w: F.split(F.regexp_replace(F.regexp_replace(w, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2"), " ")
    return F.array_distinct(F.transform(F.filter(F.flatten(F.transform(words, split)), lambda w: F.length(w) >= 2), lambda w: F.lower(w)))


#: Language of a file extension (fixed values).
LANGUAGES = {".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "jsx", ".py": "python", ".pyi": "python"}


def language_of(path: Column) -> Column:
    """By the lower-case extension; unknown otherwise (FLT-7)."""
    ext = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext], F.lit("unknown"))


def is_test_path(path: Column) -> Column:
    """Names and folders of tests (FLT-9)."""
    return path.rlike(r"\.(test|spec)\.[tj]sx?$") | path.rlike(r"(^|/)tests?/") | path.rlike(r"(^|/)test_[^/]+\.py$") | path.rlike(r"_test\.py$")


def line_count(text: Column) -> Column:
    """0 for an empty text, else newlines and one (NRM-11)."""
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def first_line(text: Column, most: int) -> Column:
    return F.left(F.trim(F.substring_index(text, "\n", 1)), F.lit(most))


def first_line_signature(text: Column) -> Column:
    """The first line without a trailing brace, at most 200 characters (FN-10)."""
    return F.left(F.rtrim(F.regexp_replace(F.trim(F.substring_index(text, "\n", 1)), r"\s*\{$", "")), F.lit(200))


def slug(text: Column) -> Column:
    """Runs of other than letters and digits become one dash, none at the ends (FN-13)."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "-"), "^-|-$", ""))


def strip_frontmatter(text: Column) -> Column:
    """Without a leading block between lines of three dashes (FN-4)."""
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---[^\n]*(\r?\n|\z)", "")


def heading(text: Column) -> Column:
    """The first first-level heading, or null (FN-5)."""
    h = F.trim(F.regexp_extract(text, r"(?m)^# +(.+?)\r?$", 1))
    return F.when(h != "", F.left(h, F.lit(120)))


def note_title(text: Column, path: Column) -> Column:
    """Heading, then title of the front matter, then file name (FN-5)."""
    front = F.trim(F.regexp_replace(F.regexp_extract(text, r"(?m)\A---\r?\n(?:.*\r?\n)*?title: *(.+?)\r?$", 1), "^[\"']|[\"']$", ""))
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)\.(md|markdown)$", "")
    return F.coalesce(heading(text), F.when(front != "", F.left(front, F.lit(120))), F.left(name, F.lit(120)))


#: File extensions that references have, and frameworks whose names look like files (fixed values).
CODE_EXTENSIONS = "tsx|ts|jsx|mjs|cjs|js|py"
NOT_REFS = ("next.js", "node.js", "nest.js", "vue.js", "three.js", "express.js", "react.js", "nuxt.js")


def code_refs(text: Column) -> Column:
    """Code files named in a text, with or without folders, each once, in order (FN-7).

    A leading dot belongs to a reference only as that of a folder; the file name begins with a letter or figure."""
    found = F.regexp_extract_all(text, F.lit(rf"((?:\.[A-Za-z0-9][A-Za-z0-9_@\-]*/)?[A-Za-z0-9_@][A-Za-z0-9_@.\-/]*\.(?:{CODE_EXTENSIONS}))(?![A-Za-z0-9])"), 1)
    return F.array_distinct(F.filter(found, lambda r: F.substring_index(r, "/", -1).rlike("^[A-Za-z0-9]") & (F.length(r) >= 5) & ~F.lower(r).isin(*NOT_REFS)))


def query_terms(text: Column) -> Column:
    """Runs of letters, digits and '_' (FN-2)."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1)


def asks_in_cyrillic(text: Column) -> Column:
    """Cyrillic without a Latin word of three letters (FLT-14)."""
    return text.rlike(r"\p{IsCyrillic}") & ~text.rlike(r"[A-Za-z]{3}")


def snippet(body: Column, task: Column, size: int = 480, lead: int = 80) -> Column:
    """A window of the body around the first word of the task that it holds (FN-8)."""
    flat = F.trim(F.regexp_replace(body, r"\s+", " "))
    terms = F.slice(F.filter(F.transform(query_terms(task), lambda t: F.lower(t)), lambda t: F.length(t) >= 3), 1, 12)
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(F.lower(flat), t)), lambda p: p > 0))
    start = F.greatest(F.coalesce(at, F.lit(1)) - lead, F.lit(1))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substring(flat, start, F.lit(size)))


def dir_overlap(a: Column, b: Column) -> Column:
    """Shared leading folders as a part of the deeper path's folders (FN-15)."""
    da, db = F.slice(F.split(a, "/"), 1, F.size(F.split(a, "/")) - 1), F.slice(F.split(b, "/"), 1, F.size(F.split(b, "/")) - 1)
    n = F.least(F.size(da), F.size(db))
    same = F.aggregate(F.sequence(F.lit(0), n), F.struct(F.lit(0).alias("k"), F.lit(True).alias("go")), lambda s, i: F.struct((s["k"] + F.when(s["go"] & (i < n) & (F.get(da, i) == F.get(db, i)), 1).otherwise(0)).alias("k"), (s["go"] & (i < n) & (F.get(da, i) == F.get(db, i))).alias("go")))
    return same["k"] / F.greatest(F.size(da), F.size(db), F.lit(1))


#: Weight of a knowledge section by its two leading digits (fixed values).
SECTIONS = {"00": 0.7, "01": 1.4, "02": 1.5, "03": 1.3, "04": 1.0, "05": 0.6, "06": 1.1, "13": 1.1}


def section_weight(tags: Column) -> Column:
    key = F.regexp_extract(F.coalesce(F.get(tags, F.lit(1)), F.lit("")), r"^(\d{2})", 1)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])[key], F.lit(1.0))


def title_boost(title: Column, query_words: Column) -> Column:
    """1 and the part of the query's words that the title has (FN-25); words of three letters at least."""
    long_ = lambda a: F.filter(a, lambda w: F.length(w) >= 3)
    q = F.array_distinct(long_(query_words))
    return F.when(F.size(q) == 0, 1.0).otherwise(1.0 + F.size(F.array_intersect(long_(subtokenize(title)), q)) / F.size(q))


def embedding_text(path: Column, name: Column, signature: Column, docstring: Column) -> Column:
    """What is embedded for a symbol: its non-blank parts with line breaks between (FN-21)."""
    return F.array_join(F.filter(F.array(path, name, signature, docstring), lambda x: x.isNotNull() & (F.trim(x) != "")), " \n ")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)
