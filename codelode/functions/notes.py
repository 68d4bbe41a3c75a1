"""Titles, types, sentences, roles and small maps, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelode.functions import text as t

#: Roles of files by their lower-case names, the first that fits (fixed values): on cards and in roll-ups of modules.
CARD_ROLES = [(".service.", "service"), (".controller.", "HTTP controller (routes)"), (".worker.", "background worker"), (".cron.", "scheduled job (cron)"), (".dto.", "data shapes (DTO)"), (".module.", "DI module"), (".guard.", "access guard"), (".resolver.", "resolver")]
WIKI_ROLES = [(".service.", "service"), (".controller.", "HTTP controller"), (".worker.", "worker"), (".cron.", "cron job"), (".dto.", "DTO"), (".module.", "module"), (".guard.", "guard")]
ENTRY_POINT = r"(^|/)(index|main|app|server|cli)\.[a-z]+$"
#: Types of agent memories (fixed values).
MEMORY_TYPES = "user|feedback|project|reference"
#: Fence of a code block by language (fixed values).
FENCES = {"typescript": "ts", "tsx": "ts", "javascript": "js", "jsx": "js", "python": "python"}
#: What instruction-tuned models are told before a query (fixed value).
QUERY_INSTRUCTION = "Given a coding task in any language, retrieve the most relevant code."
#: Lengths of sentences and quotations (fixed values).
SENTENCE, WHOLE, QUOTE = 130, 279, 278


def card_role(path: Column) -> Column:
    """The role that a file's name suggests on its card (FN-16)."""
    name, out = F.lower(F.substring_index(path, "/", -1)), None
    for part, role in CARD_ROLES:
        out = F.when(name.contains(part), role) if out is None else out.when(name.contains(part), role)
    return out.when(path.rlike(ENTRY_POINT), "entry point").otherwise("module")


def wiki_role(path: Column) -> Column:
    """The role in a module's roll-up (FN-16)."""
    low, out = F.lower(path), None
    for part, role in WIKI_ROLES:
        out = F.when(low.contains(part), role) if out is None else out.when(low.contains(part), role)
    return out.when(low.rlike(r"\.(tsx|jsx)$"), "UI component").when(low.rlike(ENTRY_POINT), "entry point").otherwise("file")


def front_matter(text: Column) -> Column:
    """The leading block between lines of three dashes, or an empty text."""
    return F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(.)\.[^.]*$", "$1")


def memory_title(text: Column, path: Column) -> Column:
    """name: of the front matter, then the first heading, then the file name (FN-6)."""
    name = F.regexp_replace(F.regexp_extract(front_matter(text), r"(?m)^name:[^\S\n]*(.+?)\s*$", 1), "^[\"']|[\"']$", "")
    h1 = F.trim(F.regexp_extract(t.strip_frontmatter(text), r"(?m)^#[^\S\n]+(.+?)\s*$", 1))
    return F.coalesce(F.when(name != "", F.left(F.trim(name), F.lit(120))), F.when(h1 != "", F.left(h1, F.lit(120))), _stem(path))


def memory_type(text: Column, path: Column) -> Column:
    """type: of the front matter, then the first word of the file name, then nothing (FN-6)."""
    told = F.regexp_extract(front_matter(text), rf"(?m)^\s*type:\s*({MEMORY_TYPES})\s*$", 1)
    prefix = F.regexp_extract(_stem(path), "^([^_-]*)", 1)
    return F.when(told != "", told).when(prefix.isin(*MEMORY_TYPES.split("|")), prefix).otherwise("")


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def first_sentence(doc: Column) -> Column:
    """The first sentence of a text on one line, 130 characters at most (FN-12)."""
    one = flat(F.coalesce(doc, F.lit("")))
    s = F.regexp_extract(one, r"^(.+?[.!?])(\s|$)", 1)
    return F.left(F.when(s != "", s).otherwise(one), F.lit(SENTENCE))


def prose_of(body: Column) -> Column:
    """The running text of a note: no headings, tables, pictures, fences and rules, no list and quotation marks (FN-12)."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    lines = F.filter(lines, lambda x: ~x.rlike(r"^(#|\||!\[|```|---|===|<!--)") & (x != ""))

    def bare(x: Column) -> Column:
        for pattern in (r"^>+\s*", r"^[-*+]\s+", r"^\d+\.\s+", r"\*\*", "^_+", "_+$"):
            x = F.regexp_replace(x, pattern, "")
        return x

    lines = F.transform(lines, bare)
    return flat(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def cut_to_word(text: Column, limit: int) -> Column:
    """At most so many characters, to the end of a word if one ends in the second half (FN-12)."""
    head = F.left(text, F.lit(limit))
    at = F.length(head) - F.instr(F.reverse(head), " ")
    to_word = F.when((F.instr(head, " ") > 0) & (at > limit / 2), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.rtrim(to_word))


def quote_from(body: Column) -> Column:
    """A quotation of the running text: whole if short, else to the end of a sentence, else of a word (FN-12)."""
    prose = prose_of(body)
    head = F.left(prose, F.lit(QUOTE))
    sentence = F.trim(F.regexp_extract(head, r"^(.*[.!?…])(\s|$)", 1))
    return F.when(F.length(prose) <= WHOLE, prose).when(F.length(sentence) >= QUOTE / 3, sentence).otherwise(cut_to_word(head, QUOTE))


def humanised_title(path: Column) -> Column:
    """The words of a file's name (FN-18)."""
    base = _stem(path)
    words = F.array_join(t.subtokenize(base), " ")
    return F.when(words != "", words).otherwise(base)


def fence_lang(language: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in FENCES.items() for x in kv])[language], F.lit(""))


def embedding_family(model: Column) -> Column:
    """e5, qwen3 or generic, by the name of an embedding model (FN-22)."""
    low = F.lower(F.coalesce(model, F.lit("")))
    return F.when(low.contains("qwen3"), "qwen3").when(low.contains("e5"), "e5").otherwise("generic")


def query_text(family: Column, text: Column) -> Column:
    """A query as a model of this family wants it (FN-22)."""
    return F.when(family == "e5", F.concat(F.lit("query: "), text)).when(family == "qwen3", F.concat(F.lit(f"Instruct: {QUERY_INSTRUCTION}\nQuery:"), text)).otherwise(text)


def passage_text(family: Column, text: Column) -> Column:
    return F.when(family == "e5", F.concat(F.lit("passage: "), text)).otherwise(text)


def tokenizer_family(model: Column) -> Column:
    """claude, gpt or generic, by the name of a model, in this order (FN-23)."""
    low = F.lower(F.coalesce(model, F.lit("")))
    return F.when(low.rlike("claude|sonnet|opus|haiku"), "claude").when(low.rlike("gpt|o1|o3|o4|4o|openai"), "gpt").otherwise("generic")


def edge_confidence(average: Column) -> Column:
    """Confidence of an answer made of heuristic edges: nine tenths of their average, between 0 and 1 (NRM-13)."""
    return F.least(F.greatest(F.coalesce(average, F.lit(0.0)) * 0.9, F.lit(0.0)), F.lit(1.0))
