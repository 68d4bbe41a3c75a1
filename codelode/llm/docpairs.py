"""Functions paired with their documentation, by island grammars.

Of a source file only the islands are parsed: documentation comments, annotations, signatures
and balanced bodies; everything between is water and is skipped. Of a documentation comment the
islands are its sentences and the descriptions of its tags; marks, rules, directives, legal
text, references, stand-ins and dead code are water. A function counts as documented when an
island tells something that its name and signature do not.

Defined results: a null, empty or blank docstring, a null signature and a null kind give no
row; a symbol that comes several times counts once; a null name or qualified name takes nothing
away from the docstring; very long docstrings are read whole; extra columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- islands of a documentation comment ------------------------------------------------------

MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|/{2,}!?|#+(?!region|endregion)[:!]?|[rRuUbB]{0,2}\"{3}|'{3}|<!--|--(?=\s|$))\s?|\s*(?:\*+/|\"{3}|'{3}|-->)\s*$")
RULE = re.compile(r"^[\W_]*$")
BANNER = re.compile(r"^\s*([-=*#~_+.])\1{2,}.*\1{2,}\s*$")
#: Comments that speak to tools.
DIRECTIVE = re.compile(
    r"^\s*@?(?:eslint|prettier|istanbul|pylint|noqa|nosec|nolint|flake8|mypy|pyright|ruff|isort|yapf|black|fmt|c8|v8|jshint|jslint|tslint|ts|tsc|webpack\w*|vite|sourcemappingurl|sonar|coverage|pragma|type|region|endregion|jsx\w*|flow|babel|global|exported|stylelint|biome|deno|nyc)"
    r"(?:\b[-: ]|$)|^\s*#?(?:end)?region\b|^\s*-\*-|^\s*vim?:|^\s*@ts-|^\s*!/",
    re.I,
)
LEGAL = re.compile(r"copyright|\(c\)\s|©|spdx-|all rights reserved|licen[cs]ed under|license(?:ref|d)?\b.*\b(?:mit|apache|bsd|gpl)|internal use only|redistribut|авторск\w+ прав|все права", re.I)
REFERENCE = re.compile(
    r"^\W*(?:@see|@link|@inheritdoc|inheritdoc|@override|@internal|@private|@public|@protected|@hidden|@ignore|@deprecated\W*$|@author|@since|@version|@module|@memberof|@class|@async|@static|@group|@category|@alpha|@beta|@api)\b[^.]*$"
    r"|^\W*(?:see|as|cf|compare|refer to|смотри|см|как)\b\W*(?:also\b\W*)?(?:the\b\W*)?(?:above|below|base|parent|super\w*|https?:|\w+\.\w+$|#\d+|[A-Z]{2,}-\d+|выше|ниже|базов\w+)[^.]*\W*$|^\W*https?://\S+\W*$|^\W*\{@\w+[^}]*\}\W*$|^\W*[A-Z]{2,}-\d+\W*$|^\W*(?:same|ditto|the same)\b[^,;]{0,30}$",
    re.I,
)
TODO = re.compile(r"\b(?:todo|fixme|xxx|tbd|hack|wip)\b", re.I)
CODE = re.compile(
    r";\s*$|^\s*[}\])]+[;,]?\s*$|[{(\[]\s*$|^\s*(?:return|await|const|let|var|import|from|export|if|for|while|raise|throw|print|console|self|this|def|class|else|elif|try|yield|del|assert)\b[^.!?]*[=(){}\[\]][^.!?]*|^\s*@\w+\([^)]*\)\s*$|^\s*[\w.]+\s*[-+*/|]?=[^=>].*$|^\s*[\w.]+\([^)]*\)\s*[:;]?\s*$|^\s*>>>|^\s*</?\w+[^>]*>\s*$"
)
#: Tags whose description tells something about the subject that they name first.
NAMED = re.compile(r"^\s*(?:@|:|\\)(?:param|parameter|arg|argument|prop|property|throws|exception|raises?|typeparam|template|keyword|key)\b\s*(?:\{[^}]*\})?\s*(?:(?<=throws) if|\[?[\w.$]+(?:=[^\]]*)?\]?)?\s*:?\s*[-–—:]?\s*(.*)$", re.I)
THROWS = re.compile(r"^\s*(?:@|:)(?:throws|exception|raises?)\b\s*(?:\{[^}]*\})?\s*:?(.*)$", re.I)
PLAIN = re.compile(r"^\s*(?:@|:|\\)(?:returns?|yields?|rtype|type|example|default|remarks?|description|summary|brief|note|todo|deprecated)\b\s*:?\s*(?:\{[^}]*\})?\s*:?\s*[-–—:]?\s*(.*)$", re.I)
SECTION = re.compile(r"^\s*(?:args?|arguments|params?|parameters|returns?|yields?|raises|throws|attributes|keyword args|параметры|возвращает)\s*:\s*(.*)$", re.I)
ITEM = re.compile(r"^\s*[-*]?\s*[\w.$]+\s*(?:\([^)]*\))?\s*:\s+(.*)$")


def strip_marks(line: str) -> str:
    while True:
        shorter = MARKS.sub("", line)
        if shorter == line:
            return line.strip()
        line = shorter


def doc_islands(doc: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of each island of a documentation comment; kind is prose, tag or list."""
    prose: list[str] = []
    listing = False
    for raw in doc.replace("\r", "\n").split("\n"):
        line = strip_marks(raw)
        if not line or RULE.match(line) or BANNER.match(raw.strip()) or BANNER.match(line):
            listing = listing and bool(line)
            continue
        if DIRECTIVE.match(line) or LEGAL.search(line) or REFERENCE.match(line):
            continue
        # several tags may share one line
        for part in re.split(r"(?<=\s)(?=(?:@\w+|:(?:param|returns?|raises|type|rtype)\b))", line):
            part = part.strip()
            if not part:
                continue
            if m := THROWS.match(part):
                yield "tag", m[1]
            elif m := NAMED.match(part):
                yield "tag", m[1]
            elif m := PLAIN.match(part):
                yield "tag", m[1]
            elif m := SECTION.match(part):
                listing = True
                yield "list", m[1]
            elif listing and (m := ITEM.match(part)):
                yield "tag", m[1]
            elif REFERENCE.match(part) or DIRECTIVE.match(part) or part.startswith("@") and " " not in part:
                continue
            elif CODE.search(part):
                continue
            else:
                prose.append(part)
    for sentence in re.split(r"(?<=[.!?])\s+|\n", "\n".join(prose)):
        if sentence and not LEGAL.search(sentence) and not REFERENCE.match(sentence) and not TODO.search(sentence):
            yield "prose", sentence


# --- what an island adds ---------------------------------------------------------------------

#: Words that say nothing about behaviour, input, result or limits.
EMPTY_WORDS = frozenset(
    """a an the this that these those it its is are was were be been being will would can could should may might must do does did done
    to of in on at by for from with into onto as and or but if then than so such via per up out off over under about any all each every
    we you they he she i my our your their his her which what when where who whom how why there here also just only own same other given
    method function func procedure routine member class constructor helper util utility utilities handler implementation implements
    handle handles handling perform performs performing operation operations execute executes execution process processes processing
    responsible used use uses using useful purpose main simple basic standard common default
    param params parameter parameters arg args argument arguments return returns returned value values result results object
    string number boolean bool int integer float str dict list array none null undefined void any unknown type types
    description describe describes documentation document documented doc docs docstring comment comments summary
    todo fixme xxx tbd wip hack stub placeholder dummy missing empty goes here add write fill later please na generated auto automatically
    see above below public private protected internal api helpers section region start end begin
    implement implemented does thing things stuff work works logic code new current specified provided relevant respective corresponding appropriate
    описание заглушка метод функция параметр параметры возвращает значение нет пусто написать документация документировать для и в на по из с к у о от""".split()
)
#: Verbs that say the same: a docstring's verb restates any of its line in the name.
VERBS = [
    "get fetch load read retrieve obtain find lookup look query return give",
    "set assign put store save write update change modify",
    "make create build construct generate produce compute calculate determine evaluate derive",
    "remove delete drop erase clear cancel close",
    "check verify validate test ensure examine",
    "send notify emit publish dispatch inform alert",
    "merge join combine unite",
    "split divide separate",
    "sort order rank",
    "parse read interpret",
    "export output dump",
    "import load",
    "register record enrol add",
    "schedule plan",
    "estimate guess approximate calculate compute",
    "archive store keep",
    "resolve find determine",
    "match compare",
    "sync synchronise synchronize",
    "group bucket collect",
    "run execute start",
]
WORD = re.compile(r"[^\W_]+")
SUBTOKEN = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_a-zA-Z]+")


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if len(w) > 5 and w.endswith("ing"):
        w = w[:-3]
        w = w[:-1] if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "sl" else w
    elif len(w) > 4 and w.endswith("ed"):
        w = w[:-2]
        w = w[:-1] if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "sl" else w
    elif len(w) > 4 and w.endswith(("ches", "shes", "sses", "xes")):
        w = w[:-2]
    elif len(w) > 3 and w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w.endswith("e") else w


EMPTY_STEMS = frozenset(stem(w) for w in EMPTY_WORDS) | EMPTY_WORDS
VERB_GROUPS: dict[str, set[str]] = {}
for _group in VERBS:
    for _w in _group.split():
        VERB_GROUPS.setdefault(stem(_w), set()).update(stem(x) for x in _group.split())


def said(*names: str | None) -> set[str]:
    """Stems that a name and a signature already say, with verbs that mean the same."""
    out: set[str] = set()
    for n in names:
        for w in SUBTOKEN.findall(n or ""):
            out.add(stem(w))
            out.add(w.lower())
    for w in list(out):
        out |= VERB_GROUPS.get(w, set())
    return out


def news(text: str, known: set[str]) -> list[str]:
    """The words of `text` that neither the known stems nor empty words cover."""
    out = []
    for k, w in enumerate(WORD.findall(text)):
        for part in SUBTOKEN.findall(w) or [w]:
            s = stem(part)
            if (len(part) > 1 or part.isdigit()) and s not in EMPTY_STEMS and part.lower() not in EMPTY_STEMS and s not in known:
                # what an island begins with is what is done: a verb that the name has no word for is news by itself
                out += [s] * (2 if not k and s not in VERB_GROUPS else 1)
    return out


#: A sentence or description with so many new words tells something.
ENOUGH = 2


def tells(doc: str | None, name: str | None, qualified: str | None, signature: str | None) -> bool:
    """Whether a docstring tells at least one thing that the name and the signature do not."""
    if not doc or not doc.strip():
        return False
    known = said(name, qualified, signature)
    return any(len(news(text, known)) >= ENOUGH for kind, text in doc_islands(doc) if text)


# --- islands of a source file ----------------------------------------------------------------

STRING_OR_COMMENT = {
    "python": re.compile(r"(?P<doc>)(?:#[^\n]*|[rRbBuUfF]{0,2}(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'))", re.S),
    "js": re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
}
OPEN, CLOSE = "([{", ")]}"


def body_end(lines: list[str], start: int, language: str) -> int:
    """The last line (from 0) of the function whose signature begins on line `start`: a balanced body
    or, in Python, an indented suite."""
    if language == "python":
        indent = len(lines[start]) - len(lines[start].lstrip())
        end, depth = start, 0
        for i in range(start, len(lines)):
            text = lines[i]
            if i > start and depth <= 0 and text.strip() and len(text) - len(text.lstrip()) <= indent:
                break
            code = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|#.*", "", text)
            depth += sum(code.count(c) for c in OPEN) - sum(code.count(c) for c in CLOSE)
            if text.strip():
                end = i
        return end
    text, depth, seen, at = "\n".join(lines[start:]), 0, False, 0
    water = STRING_OR_COMMENT["js"]
    while at < len(text):
        if m := water.match(text, at):
            at = max(m.end(), at + 1)
            continue
        c = text[at]
        if c in OPEN:
            depth += 1
            seen = seen or c == "{"
        elif c in CLOSE:
            depth -= 1
            if depth <= 0 and seen and c == "}":
                break
        elif c == ";" and depth <= 0:
            break
        at += 1
    return start + text.count("\n", 0, min(at, len(text)))


def lines_of(content: str | None) -> list[str]:
    return (content or "").lstrip("\ufeff").replace("\r\n", "\n").split("\n")


def code_of(lines: list[str], language: str | None, signature: str | None, first: int | None) -> str | None:
    """The code of a symbol: from its signature line to the end of its balanced body.

    `first` (from 1) may be off; the signature is searched for near it. None if the file does not hold it."""
    if not signature or not signature.strip():
        return None
    head = signature.strip().split("\n")[0].strip()
    at = [i for i, x in enumerate(lines) if head in x]
    if not at:
        return None
    start = min(at, key=lambda i: abs(i - ((first or 1) - 1)))
    end = body_end(lines, start, "python" if language == "python" else "js")
    while start and re.match(r"\s*@\w", lines[start - 1]):
        start -= 1  # annotations belong to the island
    return "\n".join(lines[start : end + 1])


# --- operators -------------------------------------------------------------------------------


def functions(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind in ('function', 'method') and signature is not null and docstring is not null and id is not null")


def documented(symbols: DataFrame) -> DataFrame:
    """The function and method rows whose docstring tells something, each id once."""

    @F.pandas_udf("boolean")
    def informative(doc: pd.Series, name: pd.Series, qualified: pd.Series, signature: pd.Series) -> pd.Series:
        return pd.Series([tells(*x) for x in zip(doc, name, qualified, signature, strict=True)], dtype=bool)

    rows = functions(symbols).select("id", "file_id", "name", "qualified_name", "kind", "signature", "docstring", "start_line", "end_line")
    return rows.where(informative("docstring", "name", "qualified_name", "signature")).dropDuplicates(["id"])


#: Functions of one file that are cut out of its text together.
TOGETHER = 200


def pairs(symbols: DataFrame, files: DataFrame, blobs: DataFrame) -> DataFrame:
    """(symbol_id, qualified_name, signature, description, code) of every documented function; code is
    null where the file or the signature in it is missing.

    The functions of a file meet its text as one row (of up to about TOGETHER functions), so that a text moves
    once and is cut into lines once."""
    language = files.where("id is not null").groupBy(F.col("id").alias("file_id")).agg(F.max(F.struct("updated_at", "language")).getField("language").alias("language"))
    text = blobs.where("file_id is not null").groupBy("file_id").agg(F.max("content").alias("content")).join(language, "file_id", "left")
    found = documented(symbols)
    parts = found.where("file_id is not null").groupBy("file_id").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    dealt = found.join(parts, "file_id", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(64))))
    rows = dealt.groupBy("file_id", "part").agg(F.collect_list(F.struct("id", "qualified_name", "signature", "docstring", "start_line")).alias("functions"))

    def run(batches):
        for b in batches:
            out = []
            for content, lang, functions in zip(b["content"], b["language"], b["functions"], strict=True):
                lines = lines_of(content)
                for f in functions:
                    description = "\n".join(t.strip() for _, t in doc_islands(f["docstring"]) if t.strip())
                    first = f["start_line"]
                    out.append((f["id"], f["qualified_name"], f["signature"], description, code_of(lines, lang, f["signature"], None if pd.isna(first) else int(first))))
            yield pd.DataFrame(out, columns=["symbol_id", "qualified_name", "signature", "description", "code"])

    schema = "symbol_id long, qualified_name string, signature string, description string, code string"
    return rows.join(text, "file_id", "left").select("functions", "content", "language").mapInPandas(run, schema)
