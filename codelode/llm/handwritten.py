"""Files that nobody wrote by hand: tool output, minified code, third-party copies, stored data.

Each file is lexed and laid out again in a canonical form, one line for each statement and each
opened or closed block, and the form is compared with the layout found. Extreme expansion without
the spaces people write marks minified code; a text that is mostly one literal (a string, a list
of numbers or of strings) is stored data. Perfect uniformity, every line as the canonical form
has it, is measured too (`uniform`), but does not tell tool output from careful hand-written code
(figures in the README): tool output is known by its banner, its name or its place. Place and
notice tell third-party copies; a file equal to one of those, line ends (the last one too) and
byte order mark aside, is a copy too.

Defined results: a file without text (null content or no row) is judged by its path alone; an
empty or blank text is no case by itself; versions of a file count once, by the newest path; a
file row without text and a text without file row are judged by what is there; a null id gives
no row; very long texts and heads are lexed whole, in any language; extra columns are not read;
empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.session import cut

# --- place -----------------------------------------------------------------------------------

#: Folders that hold copies of other people's code (fixed values).
VENDOR_DIRS = "(?:vendor|_vendor|third_party|third-party|thirdparty|3rdparty|node_modules|bower_components|external|externals|extern|deps|site-packages|jspm_packages)"
VENDORED = rf"(?i)(?:^|/){VENDOR_DIRS}/"
#: Names of files that a tool writes.
TOOL_NAMES = r"(?i)(?:^|/)(?:__generated__|\.next|__pycache__)/|\.lock$|(?:^|/)(?:package-lock|npm-shrinkwrap|composer\.lock|pnpm-lock)\.(?:json|yaml)$|(?:_pb2(?:_grpc)?\.pyi?|\.(?:pb|g|gen|generated)\.[a-z]+|\.designer\.cs)$"
MINIFIED_NAMES = r"(?i)[.-]min\.(?:m?js|css|cjs)$|\.bundle\.js$|\.map$"


def by_place(path: Column) -> Column:
    return F.coalesce(path.rlike(VENDORED), F.lit(False))


# --- banner and notice -----------------------------------------------------------------------

COMMENT_LINE = re.compile(r"^\s*(?://+|#+!?|/\*+!?|\*+/?|--|;+|<!--|'{3}|\"{3})")
TOOL_BANNER = re.compile(
    r"@generated\b|<auto-?generated>|\bauto-?\s?generated\s+(?:file|code|by|from|with|,|do|-|—)|^\W*auto-?generated\W*$|\bautogenerated\b"
    r"|\b(?:file|code|module|class|source|types?|client|bindings?)\b(?:\s+(?:is|was|has been))?\s+(?:auto(?:matically)?[- ])?(?:generated|produced|emitted|created|built|compiled|written)\s+(?:by|from|with|automatically)\b"
    r"|\b(?:generated|produced|emitted|built|compiled|created|rendered|written)\b\s+(?:automatically\b|by\s+\S+|from\s+\S+\s+by\b|from\s+\S+\s+at\s+(?:build|compile)\s+time)"
    r"|\b(?:machine|tool)[- ](?:written|generated|made|produced)\b|\boutput of \S+,"
    r"|\bdo not (?:edit|modify|change|touch)\b|\bdon'?t (?:edit|modify)\b|\bnot (?:be )?edit(?:ed)? (?:manually|by hand)\b|\b(?:changes|edits|modifications) (?:will be|are|get) (?:overwritten|lost|discarded)\b"
    r"|создан\w* автоматически|сгенерирован\w*|автоматически (?:создан|сгенерирован)\w*|не (?:редактировать|изменять|править)",
    re.I,
)
#: Words that turn a banner into a remark about banners or into work to be done.
NOT_BANNER = re.compile(r"no longer|not generated|used to|freely|stub|writes? the|replaces?|reads? the|checks?|strips?|detect|banner|\bmust\b|\bshould\b|больше не|раньше", re.I)
NOTICE = re.compile(r"\(c\)|©|\bcopyright\b|@licen[cs]e|@preserve|spdx-license-identifier", re.I)
VERSION_TITLE = re.compile(r"^\W*[\w@/.-]+\s+v?\d+\.\d+(?:\.\d+)?\b\W*$", re.I)
LICENCE = re.compile(r"\b(?:released|distributed|licen[cs]ed|available|published)\s+under\b|\b(?:MIT|BSD|Apache|MPL|ISC|[AL]?GPL)\b|\bpermissive\b|see (?:the )?(?:NOTICE|LICEN[CS]E)", re.I)


def head_of(text: str) -> list[str]:
    """The comment lines before the first line of code."""
    out = []
    block = False
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            continue
        if block or COMMENT_LINE.match(s):
            out.append(s)
            if s.startswith("/*") or s[:3] in ("'''", '"""'):
                block = True
            if "*/" in s or (len(s) > 3 or len(out) > 1) and s.endswith(("'''", '"""')):
                block = False
            continue
        break
    return out


def banner(head: list[str]) -> bool:
    return any(TOOL_BANNER.search(x) and not NOT_BANNER.search(x) for x in head)


def foreign_notice(head: list[str], owner: str) -> bool:
    """A notice at the head that names somebody else than the owner as holder."""
    marks = [x for x in head if NOTICE.search(x)]
    if not marks:
        return False
    others = [x for x in marks if owner.lower() not in x.lower()]
    titled = any(VERSION_TITLE.match(x.strip("/*#! ")) for x in head)
    return bool(others) and (titled or any(LICENCE.search(x) for x in head) or any(re.search(r"\bauthors?\b|\bcontributors?\b|\bfoundation\b|\binc\b|@licen[cs]e", x, re.I) for x in others)) and not (
        len(others) < len(marks) and not titled and not any(re.search(r"\(c\)|copyright", x, re.I) for x in others)
    )


# --- layout ----------------------------------------------------------------------------------

#: By whether a hash begins a comment.
TOKENS = {
    hashed: re.compile(
        (r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|\#[^\n]*)" if hashed else r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))")
        + r"|(?P<regex>(?:(?<=[=(,:!&|?\[]\s)|(?<=[=(,:!&|?\[])|(?<=return\s))/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)"
        r"|(?P<string>[rRbBuUfF]{0,2}(?:\"{3}.*?(?:\"{3}|\Z)|'{3}.*?(?:'{3}|\Z))|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)|`(?:\\.|[^`\\])*(?:`|\Z))"
        r"|(?P<number>\b\d[\w.]*)|(?P<word>[^\W\d]\w*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<end>;)|(?P<line>\n)|(?P<punct>[^\s\w])",
        re.S,
    )
    for hashed in (True, False)
}


#: Languages whose comments begin with a hash, and formats in which keys are literals too (by extension).
HASH_COMMENTS = frozenset("py pyi sh bash yaml yml toml ini cfg conf properties env local lock rb pl r mk".split())
KEYED = frozenset("json yaml yml toml ini cfg conf properties env local".split())


def layout(text: str, hash_comments: bool, keyed: bool = False) -> dict:
    """The canonical lines of a text, and counts over its tokens and its own lines.

    keyed: a colon ends a run of literals, as in formats whose keys are literals."""
    tokens = literal = largest = run = depth = names = spaces = longest = 0
    canonical: list[str] = []
    line: list[str] = []
    last = 0

    def close():
        if line:
            canonical.append("".join(line))
            line.clear()

    for m in TOKENS[hash_comments].finditer(text):
        kind = m.lastgroup
        at, last, size = last, m.end(), m.end() - m.start()
        if kind == "comment":
            continue
        if kind == "line":
            if hash_comments and depth <= 0:
                close()
            continue
        tokens += 1
        spaces += " " in text[at : m.start()]
        line.append(m[0])
        if kind in ("string", "number"):
            literal += size
            run += size
            longest = max(longest, size)
        elif kind == "punct" and m[0] in (",-+." if keyed else ",:-+."):
            pass
        elif kind in ("open", "close") and m[0] in "[]{}" and run:
            pass
        else:
            largest, run = max(largest, run), 0
        if kind == "word":
            names += 1
        elif kind == "open":
            depth += m[0] == "("
            if m[0] == "{":
                close()
        elif kind == "close":
            depth -= m[0] == ")"
            if m[0] == "}":
                close()
        elif kind == "end" and depth <= 0:
            close()
    close()
    own = ["".join(x.split()) for x in text.split("\n") if x.strip() and not COMMENT_LINE.match(x)]
    same = Counter("".join(x.split()) for x in canonical) & Counter(own)
    return {
        "tokens": tokens,
        "canonical": len(canonical),
        "lines": len(own),
        "mean": sum(map(len, own)) / max(len(own), 1),
        "uniform": sum(same.values()) / max(len(own), 1),
        "spaces": spaces / max(tokens, 1),
        "literal": literal,
        "largest": max(largest, run),
        "longest": longest,
        "names": names,
    }


#: Minified: the canonical form has so many times the lines, the lines are so long on average, and no more than so many
#: tokens have a space before them.
EXPANSION, MEAN_LINE, SPACES = 3.0, 100, 0.3
#: Stored data: so large, so large a part of the text in one literal, and a name only every so many characters.
DATA_SIZE, DATA_SHARE, DATA_NAMES = 2000, 0.6, 60


def minified(facts: dict) -> bool:
    return facts["canonical"] >= EXPANSION * max(facts["lines"], 1) and facts["mean"] >= MEAN_LINE and facts["spaces"] <= SPACES


def stored_data(text: str, facts: dict) -> bool:
    size = len(text)
    return size >= DATA_SIZE and facts["largest"] >= DATA_SHARE * size * 0.6 and (facts["literal"] >= DATA_SHARE * size or facts["largest"] >= 0.45 * size) and facts["names"] * DATA_NAMES <= size


def why(path: str | None, language: str | None, text: str | None, owner: str) -> str | None:
    """third_party, generated, minified, data, or None for hand-written."""
    path = path or ""
    if re.search(VENDORED, path):
        return "third_party"
    if re.search(TOOL_NAMES, path):
        return "generated"
    if text is None or not text.strip():
        return "minified" if re.search(MINIFIED_NAMES, path) else None
    text = text.lstrip("﻿").replace("\r\n", "\n")
    head = head_of(text)
    if banner(head):
        return "generated"
    if foreign_notice(head, owner):
        return "third_party"
    ending = path.rsplit(".", 1)[-1].lower()
    facts = layout(text, language == "python" or ending in HASH_COMMENTS, ending in KEYED)
    if stored_data(text, facts):
        return "data"
    return "minified" if minified(facts) or re.search(MINIFIED_NAMES, path) else None


# --- operators -------------------------------------------------------------------------------


def judged(files: DataFrame, blobs: DataFrame, owner: str) -> DataFrame:
    """(file_id, path, language, reason, same): one row per file; same is the hash of its text, line ends and byte order mark aside."""

    @F.pandas_udf("string")
    def reason(path: pd.Series, language: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([why(p, g, t, owner) for p, g, t in zip(path, language, content, strict=True)], dtype=object)

    newest = files.where("id is not null").groupBy(F.col("id").alias("file_id")).agg(F.max(F.struct("updated_at", "path", "language")).alias("f"))
    newest = newest.select("file_id", "f.path", "f.language")
    text = blobs.where("file_id is not null").select("file_id", "content")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", "^﻿", ""), "\r\n?", "\n"), "\n+$", "")
    return (
        newest.join(text, "file_id", "full")
        .select("file_id", "path", "language", reason("path", "language", "content").alias("reason"), F.when(F.trim(F.coalesce(plain, F.lit(""))) != "", F.sha2(plain, 256)).alias("same"))
        .dropDuplicates(["file_id"])
    )


def not_handwritten(files: DataFrame, blobs: DataFrame, owner: str) -> DataFrame:
    """(file_id, reason) of the files that nobody wrote by hand.

    Only texts of third-party copies spread to equal files, by a join on the hash: one row per
    distinct text, however many copies it has. Of the other rows only those with a text take part, and
    no text moves."""
    all_ = cut(judged(files, blobs, owner))
    copied = all_.where("reason = 'third_party' and same is not null").select("same").distinct()
    copies = all_.where("reason is null and same is not null").join(copied, "same", "left_semi").select("file_id", F.lit("third_party").alias("reason"))
    return all_.where("reason is not null").select("file_id", "reason").unionByName(copies)
