"""Credentials embedded in source code and configuration, found lexically and redacted in place.

Code is lexed as a whole into comments and literals, so that strings over several lines, templates,
block comments and quotes inside comments are known for what they are; configuration files are read
line by line. Of these come names and literals: quoted literals of code and of the text in comments
and long strings, bare values of configuration files, and the fields of structured literals
(addresses with user and password, query parameters, headers, connection strings, SQL grants,
command lines). A literal counts when
it is assigned or passed to a name of a credential, or has the form of one, and is no stand-in,
reference, hash, checksum, identifier or public key. Redaction replaces only the contents of the
literal, so that delimiters, escapes and line ends stay as they are.

Defined results: a null, empty or blank content gives no row; a null language or path means that
both forms, code and configuration, are tried; a text that comes several times for one file
counts once; a private key block counts once, by its BEGIN line; very long lines and texts are
read whole; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REDACTED = "REDACTED"

# --- names -----------------------------------------------------------------------------------

SUBTOKEN = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Words that make a name that of a credential by themselves.
STRONG = frozenset("password passwd pwd passphrase passcode secret secrets credential credentials psw".split())
#: Words before `pass` that make it a ticket or a round, not a password.
NOT_PASS = frozenset("boarding season day bus rail ski gate by first second next last render single multi low high band two".split())
#: Words that do so for values that look like keys.
WEAK = frozenset("token tokens tok key keys auth authorization bearer jwt pat apikey access sig signature login cred creds pin session cookie salt".split())
#: Words that make the name mean something else.
OTHER = frozenset("hash hashed digest checksum sha sha1 sha256 sha512 md5 fingerprint integrity public pub cert certificate label msg message placeholder hint title text error prompt path file filename dir folder count length len size ttl limit max min type kind regex pattern format field column header name url uri shortcut hotkey primary foreign sort cache etag rev revision commit uuid icon image img rule rules policy strength".split())


#: Words to which a few letters may be glued without another meaning.
GLUED = tuple("password passwd passphrase secret token credential key auth signature session hash digest checksum label shortcut fingerprint integrity rule policy".split())
#: Calls whose last literal, behind a user, is a password.
LOGIN_CALL = re.compile(r"(?:^|[._])(?:connect|login|log_in|logIn|signIn|sign_in|authenticate|auth|basic_?auth|HTTPBasicAuth|createConnection|create_connection|createClient|open_session)$", re.I)


@lru_cache(maxsize=200_000)
def name_kind(name: str) -> str:
    """strong, weak or other."""
    words = [w.lower() for w in SUBTOKEN.findall(name)]
    # a number or a few letters may be glued to the last word
    words += [w for t in words for w in GLUED if t.startswith(w) and len(t) - len(w) <= 3]
    if not words or OTHER.intersection(words):
        return "other"
    joined = "".join(words)
    if "pass" in words and not NOT_PASS.intersection(words):
        return "strong"
    if STRONG.intersection(words) or "password" in joined or "passwd" in joined:
        return "strong"
    return "weak" if WEAK.intersection(words) or "apikey" in joined else "other"


# --- values ----------------------------------------------------------------------------------

STAND_IN = re.compile(
    r"^(?:|x{3,}|\*+|\.{2,}|-+|_+|<[^>]*>|\[[^\]]*\]|\$\{?\w.*|\{\{.*\}\}|\{%.*%\}|%\(?\w.*|\{\w*\}|#\{.*\}|@@?\w+@@?|env[:.(].*|vault[:./].*|secrets?[:./].*|arn:.*|ssm:.*|file:.*|op://.*|process\.env.*|os\.(?:environ|getenv).*|see .*|ask .*|in .*|from .*|set .*|stored .*"
    r"|(?:your|my|our|the|some|any|a)?[-_ ]?(?:user(?:name)?|pass(?:word|wd|phrase)?|pwd|secret|token|api[-_ ]?key|key|value|credentials?|string|here)(?:[-_ ]?(?:here|goes[-_ ]here|value))?\d{0,3}|none|null|nil|undefined|true|false|empty|n/?a|tbd|todo|fixme"
    r"|change[-_ ]?(?:me|it|this)|replace[-_ ]?(?:me|this|with.*)|fill[-_ ]?(?:in|me|this)|insert.*|redacted|removed|hidden|masked|dummy.*|fake.*|sample.*|example.*|placeholder.*|test(?:ing)?|foo|bar|baz|abc|123(?:4(?:5(?:6)?)?)?|admin|root|guest|default|localhost|bearer|basic|digest|optional|required)$",
    re.I,
)
INNER_STAND_IN = re.compile(r"x{6,}|\*{3,}|\.{3,}|<[a-z][^>]*>|\$\{|\{\{|\bYOUR[-_]|CHANGE[-_]?ME|REPLACE[-_]?ME|PLACEHOLDER|EXAMPLE|REDACTED|FILL[-_ ]IN", re.I)
HASH_FORM = re.compile(r"^(?:\$(?:2[aby]?|1|5|6|argon2\w*|scrypt|pbkdf2\S*|apr1|y|7)\$.+|(?:sha\d*|md5|blake\w*|pbkdf2\w*|bcrypt|argon2\w*|scrypt)[-:$_].+|\{(?:SSHA|SHA|CRYPT)\w*\}.+)$", re.I)
UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
#: Forms of live tokens, whatever their name: a short prefix and a random rest.
TOKEN_FORM = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{18,}|xox[abeprs]-[\w-]{12,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[\w-]{30,}|ya29\.[\w-]{20,}|npm_\w{30,}|pypi-\w{20,}|hf_\w{20,}|dop_v1_\w{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|[a-z]{2,6}_(?=[a-z]*\d)[a-z0-9]{24,})(?![A-Za-z0-9_/+-])"
)
PRIVATE_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")

#: A line inside a key block: figures of the key, or a header of it, perhaps within a literal.
KEY_BODY = re.compile(r"^[\s\"'`+(#/*]*(?:[A-Za-z0-9+/=]*|[A-Za-z-]+: .*)(?:\\n)?[\s\"'`+,;)\\]*$")


def entropy(value: str) -> float:
    """Bits per character of the value's own letters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def stand_in(value: str) -> bool:
    v = value.strip()
    return bool(STAND_IN.match(v) or INNER_STAND_IN.search(v) or len(set(v)) <= 2)


def random_looking(value: str) -> bool:
    """Long enough, of mixed letters, without the look of words, paths or sentences."""
    v = value.strip()
    if len(v) < 12 or re.search(r"\s", v) or UUID.match(v) or HASH_FORM.match(v):
        return False
    digits, upper, lower = any(c.isdigit() for c in v), any(c.isupper() for c in v), any(c.islower() for c in v)
    if re.match(r"^(?:/|\.{1,2}/|~|https?:|[a-z]+://[^:@]*$)", v) or re.fullmatch(r"[\w.-]+\.(?:com|org|net|io|dev|test|example|invalid|json|ya?ml|py|[jt]sx?|md|txt)(?::\d+)?", v):
        return False
    if digits + upper + lower < 2:
        return False
    return entropy(v) >= 3.0 and (digits or (upper and lower and len(v) >= 16 and entropy(v) >= 3.5))


def passphrase(value: str) -> bool:
    """Words joined by dashes that end in figures, or letters with figures among them."""
    return bool(re.fullmatch(r"[a-z]+(?:[-_.][a-z]+){1,}[-_.]?\d+", value, re.I))


def live(name: str, value: str) -> bool:
    """Whether a literal given to a name is a credential."""
    v = value.strip()
    if len(v) < 6 or stand_in(v) or HASH_FORM.match(v) or UUID.match(v):
        return False
    if "-----BEGIN" in v or "://" in v or "(?" in v or re.search(r"\[[^\]]*-[^\]]*\]", v):
        return False
    kind = name_kind(name)
    if kind == "strong":
        return not re.search(r"\s", v) and (random_looking(v) or passphrase(v) or (len(v) >= 8 and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and not re.match(r"^(?:https?:|/)", v)) or (len(v) >= 8 and bool(re.search(r"[^\w\s.:/-]", v))))
    if kind == "weak":
        return random_looking(v) or passphrase(v)
    return False


# --- structured literals ---------------------------------------------------------------------

#: (words one of which must stand in the line, pattern, group of the credential, how it is judged):
#: fields inside a literal, a comment or a command.
FIELDS = [
    (("://",), re.compile(r"://([^\s:/@'\"]*):([^\s@'\"/]+)@", re.I), 2, "secret"),
    (("sig", "token", "key", "secret", "password", "pwd", "auth"), re.compile(r"[?&;](?:sig|signature|token|access_token|api_?key|key|secret|password|pwd|auth|x-amz-signature|sv?sig)=([^&\s'\"`;#]+)", re.I), 1, "random"),
    (("authorization",), re.compile(r"\bauthorization\b[\"']?\s*[:=,]\s*[\"'`]?\s*(?:basic|bearer|token|digest|apikey)\s+([^\s'\"`,;)]+)", re.I), 1, "random"),
    (("bearer", "basic"), re.compile(r"\b(?:bearer|basic)\s+([A-Za-z0-9+/=._~-]{16,})", re.I), 1, "random"),
    (("x-api", "x-auth", "private-token", "api-key"), re.compile(r"\b(?:x-(?:api|auth)-(?:key|token)|private-token|api-key)\b[\"']?\s*[:=]\s*[\"'`]?([^\s'\"`,;]+)", re.I), 1, "random"),
    (("key=", "key =", "signature=", "password=", "pwd=", "passwd=", "secret=", "token="), re.compile(r"\b(?:accountkey|sharedaccesskey|sharedaccesssignature|password|pwd|passwd|secret|secretkey|clientsecret|authtoken|accesskey)\s?=\s?([^;\s'\"`&]+)", re.I), 1, "secret"),
    (("identified",), re.compile(r"\bidentified\s+(?:with\s+\w+\s+)?by\s+(?:password\s+)?[\"'`]([^\"'`]+)", re.I), 1, "secret"),
    (("password ", "passwd ", "pwd "), re.compile(r"\b(?:password|passwd|pwd)\s+(?:to\s+)?[\"'`]([^\"'`\s]+)[\"'`]", re.I), 1, "secret"),
    (("sshpass",), re.compile(r"\bsshpass\s+-p\s*[\"']?([^\s\"']+)", re.I), 1, "secret"),
    ((" -u ", "--user"), re.compile(r"\s(?:-u|--user)[\s=]\s*[\"']?[^\s:\"']+:([^\s\"']+)", re.I), 1, "secret"),
    ((" -p", "--pass", "--token", "--secret", "--api", "--auth"), re.compile(r"(?:^|\s)(?:--?(?:password|pass|passwd|token|secret|api-key|apikey|auth-token))(?:\s+|=)[\"']?([^\s\"'-][^\s\"']*)", re.I), 1, "secret"),
    ((" / ",), re.compile(r"\b(?:login|account|user|credentials?|creds|access|sign-?in|доступ|логин)\b[^:\n]{0,60}:\s*[\w.@-]+\s/\s([^\s'\"]+)", re.I), 1, "secret"),
    (("password", "passwd", "passphrase", "pwd", "пароль"), re.compile(r"\b(?:password|passwd|passphrase|pwd|пароль)\b(?:\s+(?:is|was|for\s+\S+\s+is)|\s?[:=—-])\s*[\"'`]?([^\s\"'`,;]+)", re.I), 1, "secret"),
    (("\": ", "': ", "\":", "':"), re.compile(r"[\"'](pass(?:word|wd|phrase)?|pwd|secret|client_secret|api_?key|token|auth|access_?key|private_?key)\\?[\"']\s*:\s*\\?[\"']([^\"'\\]+)", re.I), 2, "named"),
]


def field_live(kind: str, value: str) -> bool:
    if stand_in(value) or HASH_FORM.match(value) or UUID.match(value) or len(value) < 6:
        return False
    if kind == "random":
        return random_looking(value)
    return random_looking(value) or passphrase(value) or (len(value) >= 8 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value))


# --- names and literals ----------------------------------------------------------------------

QUOTED = re.compile(r"(?P<q>[\"'`])(?P<v>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)")
#: What stands before a literal: a name and an assignment, a colon or a comparison.
NAMED = re.compile(r"(?<![\w.$-])(?:[^\WA-Za-z_]|[.-])*+([A-Za-z_$][\w.$-]*+)[\"'`]?\]?\s*(?::\s*[\w<>\[\]|. ]{1,40}?\s*)?(?:\?\?|\|\||[=!]==?|:=|=>|=|:)\s*\(?\s*[rRbBuUfF]{0,2}$")
CALL = re.compile(r"(?<![\w.$])(?:[^\WA-Za-z_]|\.)*+([A-Za-z_$][\w.$]*+)\s*(?:=\s*)?[\[({]$")
BRACKET = re.compile(r"[()\[\]{}]")
#: name = value, name: value, NAME=value of configuration files.
CONFIG = re.compile(r"^\s*(?:export\s+|set\s+|-\s+)?[\"']?(?P<n>[A-Za-z_][\w.-]*)[\"']?\s*[=:]\s*(?P<v>[^\s\"'#;].*?)\s*,?\s*$")


NEW = re.compile(r"(?:\bnew|\bawait)\s+$")
BEHIND_LITERAL = re.compile(r"[\"']\s*,\s*$")


def name_of(line: str, at: int, since: int, opened: list[tuple[int, int]]) -> str:
    """The name that the literal at `at` is assigned, given or passed to. `since` is where the literal
    before it begins, opened has the place of each open bracket and the `since` of that place."""
    if m := NAMED.search(line, since, at):
        return m[1]
    if not opened:
        return ""
    i, since_i = opened[-1]
    m = CALL.search(line, since_i, i + 1)
    if not m:
        return ""
    if LOGIN_CALL.search(m[1]) and BEHIND_LITERAL.search(line, since, at):
        return "password"
    if name_kind(m[1]) != "other":
        return m[1]
    # what a call makes of the literal goes to the name before the call
    end = m.start(1)
    if n := NEW.search(line, since_i, end):
        end = n.start()
    outer = NAMED.search(line, since_i, end)
    return outer[1] if outer else m[1]


#: Comments and closed literals of code; in scripts also regular expressions, whose quotes open nothing.
LEXED = {
    True: re.compile(r"(?P<comment>#[^\n]*)|[rRbBuUfF]{0,2}(?P<q>\"{3}|'{3})(?P<long>(?:\\.|[^\\])*?)(?P=q)|(?P<r>[\"'])(?P<short>(?:\\.|(?!(?P=r))[^\\\n])*)(?P=r)", re.S),
    False: re.compile(
        r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<q>`)(?P<long>(?:\\.|[^`\\])*)`|(?P<r>[\"'])(?P<short>(?:\\.|(?!(?P=r))[^\\\n])*)(?P=r)"
        r"|(?:(?<=[=(,:!&|?\[]\s)|(?<=[=(,:!&|?\[])|(?<=return\s))/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*",
        re.S,
    ),
}
Span = tuple[int, int, int, int]  # of a literal in its line: opening quote, contents, behind the closing quote


def quoted(line: str, at: int = 0, end: int | None = None) -> list[Span]:
    """The literals in a piece of a line that is text."""
    return [(m.start(), *m.span("v"), m.end()) for m in QUOTED.finditer(line, at, len(line) if end is None else end)]


def lexed(content: str, lines: list[str], language: str | None) -> tuple[dict[int, list[Span]], list[tuple[int, int, list[tuple[int, int, int]]]]]:
    """The literals of every line (from 0) that has any, and the literals over several lines: (line and column of the
    opening quote, (line, from, to) of the contents on each of their lines)."""
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    by_line: dict[int, list[Span]] = {}
    spread, no = [], 0
    for m in LEXED[language == "python"].finditer(content):
        kind = m.lastgroup
        if kind is None or m.group("comment") is None and m.group("long") is None and m.group("short") is None:
            continue
        at, end = m.span()
        while starts[no + 1] <= at:
            no += 1
        base = starts[no]
        text = m.group("comment") is not None
        if not text and end <= starts[no + 1]:
            inner = m.span("short") if m.group("short") is not None else m.span("long")
            quote = m.start("r") if m.group("short") is not None else m.start("q")
            by_line.setdefault(no, []).append((quote - base, inner[0] - base, inner[1] - base, end - base))
            continue
        # a comment, or a literal over several lines: text on each of its lines
        pieces, k = [], no
        first, last = (at, end) if text else m.span("long") if m.group("long") is not None else m.span("short")
        while k < len(lines) and starts[k] < last:
            a, b = max(first - starts[k], 0), min(last - starts[k], len(lines[k]))
            if a < b:
                pieces.append((k, a, b))
                if spans := quoted(lines[k], a, b):
                    by_line.setdefault(k, []).extend(spans)
            k += 1
        if not text:
            spread.append((no, at - base, pieces))
    return by_line, spread


def spread_lines(lines: list[str], spread) -> dict[int, tuple[int, int]]:
    """The lines of credentials that are written over several lines, each with the span of its part."""
    out = {}
    for no, at, pieces in spread:
        parts = [(k, lines[k][a:b].removesuffix("\r").removesuffix("\\")) for k, a, b in pieces]
        parts = [(k, t) for k, t in parts if t.strip()]
        m = NAMED.search(lines[no], 0, at)
        if m and parts and len(parts) <= 8 and live(m[1], "".join(t.strip() for _, t in parts)):
            for k, t in parts:
                a = lines[k].index(t.strip())
                out[k] = (a, a + len(t.strip()))
    return out


def literals(line: str, config: bool, name_before: str = "", spans: list[Span] | None = None) -> Iterator[tuple[int, int]]:
    """Spans of the credentials of one line; `spans` has its literals, if it was lexed."""
    name, parts, joined = "", [], ""
    end, since, seen = -1, 0, 0
    opened: list[tuple[int, int]] = []
    for start, v, w, close in quoted(line) if spans is None else spans:
        between = line[end:start] if end >= 0 else ""
        for c in BRACKET.finditer(line, seen, start):
            if c[0] in "([{":
                opened.append((c.start(), since))
            elif opened:
                opened.pop()
        seen = close
        if end >= 0 and (between.strip() in ("+", ".") or not between.strip()):
            parts.append((v, w))  # one value in several literals
            joined += line[v:w]
        else:
            if parts and live(name, joined):
                yield from parts
            name = name_of(line, start, since, opened) or (name_before if end < 0 and not line[:start].strip(" \t([+") else "")
            parts, joined = [(v, w)], line[v:w]
        end, since = close, start
    if parts and live(name, joined):
        yield from parts
    if config and (m := CONFIG.match(line)):
        value = re.sub(r"\s+[#;].*$", "", m["v"])
        if live(m["n"], value):
            yield m.start("v"), m.start("v") + len(value)
    low = line.lower()
    for words, pattern, group, kind in FIELDS:
        if any(w in low for w in words):
            for m in pattern.finditer(line):
                if kind == "named" and live(m[1], m[group]) or kind != "named" and field_live(kind, m[group]):
                    yield m.span(group)
    for m in TOKEN_FORM.finditer(line):
        if not stand_in(m[0]) and entropy(m[0]) >= 3.0:
            yield m.span()


#: What LOGIN_CALL accepts, in lower case and without what other signs cover.
LOGIN_SIGNS = "connect login log_in signin sign_in auth createclient create_connection open_session".split()
#: The signs of FIELDS, TOKEN_FORM and key blocks that are no words of names.
FORM_SIGNS = (
    "basic identified пароль логин доступ -----begin account --user :// eyj akia asia"
    " ghp_ gho_ ghu_ ghs_ ghr_ github_pat glpat xox sk_ rk_ pk_ sk- aiza ya29 npm_ pypi- hf_ dop_v1 sg."
).split() + [" -u ", " / ", " -p"]


def _least(words: Iterable[str]) -> list[str]:
    """The words that hold no other of them: who looks for these finds all."""
    words = set(words)
    return sorted(w for w in words if not any(o != w and o in w for o in words))


#: A line without any of these, LONG_TAIL and SPREAD holds nothing that the patterns above could find:
#: every word that makes name_kind strong or weak is among them, and every call of LOGIN_CALL.
SIGNS = _least([*STRONG, *WEAK, "pass", *LOGIN_SIGNS, *FORM_SIGNS])
#: The words that name_kind also finds across the parts of a name.
SPREAD = re.compile("|".join(r"[^a-z\s]*".join(w) for w in ("password", "passwd", "apikey")))
LONG_TAIL = re.compile(r"_[a-z0-9]{24}")


def worth(content: str) -> list[int]:
    """The lines, counted from 0, that hold any of the signs."""
    low = content.lower()
    if len(low) != len(content):  # a letter that grows in lower case: keep the places aligned
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in content)
    at: list[int] = [m.start() for p in (LONG_TAIL, SPREAD) for m in p.finditer(low)]
    for sign in SIGNS:
        i = low.find(sign)
        while i >= 0:
            at.append(i)
            i = low.find("\n", i)
            i = low.find(sign, i) if i >= 0 else -1
    out, line, start = [], 0, 0
    for i in sorted(at):
        line += low.count("\n", start, i)
        start = i
        if not out or out[-1] != line:
            out.append(line)
    return out


OPENED = re.compile(r"(?<![\w.$-])(?:[^\WA-Za-z_]|[.$-])*+([A-Za-z_][\w.$-]*+)[\"']?\s*(?::\s*\w+\s*)?[=:]\s*[(\\]?\s*$")
CODE = {"python", "typescript", "tsx", "javascript", "jsx"}


def found(content: str | None, language: str | None) -> list[tuple[int, list[tuple[int, int]]]]:
    """(line number, spans) of each line that holds a credential."""
    if not content:
        return []
    config = language not in CODE
    out: list[tuple[int, list[tuple[int, int]]]] = []
    lines = content.split("\n")
    key_until, after, name_before = -1, -1, ""
    signed = set(queue := worth(content))
    if not queue:
        return []
    of_line, spread = ({}, []) if config else lexed(content, lines, language)
    long_parts = spread_lines(lines, spread)
    known = (lambda no: None) if config else (lambda no: sorted(of_line.get(no, ())))
    for no in queue:
        if no <= key_until:
            continue
        line = lines[no]
        if m := PRIVATE_BEGIN.search(line):
            out.append((no + 1, [m.span()]))
            key_until = no
            if not PRIVATE_END.search(line, m.end()):
                while key_until + 1 < len(lines) and (PRIVATE_END.search(lines[key_until + 1]) or KEY_BODY.match(lines[key_until + 1])):
                    key_until += 1
                    if PRIVATE_END.search(lines[key_until]):
                        break
            continue
        spans = sorted(set(literals(line, config, name_before if no == after else "", known(no))))
        if spans:
            out.append((no + 1, spans))
        # a value on the next line
        if no + 1 < len(lines) and line[-1:] in ("=", ":", "(", "\\", " ", "\t", "\r") and (m := OPENED.search(line)):
            name_before, after = m[1], no + 1
            if after not in signed and (spans := sorted(set(literals(lines[after], False, name_before, known(after))))):
                out.append((after + 1, spans))
    hit = {no: spans for no, spans in out}
    for no, span in long_parts.items():
        if no + 1 not in hit:
            hit[no + 1] = [span]
    return sorted(hit.items())


def redact(content: str | None, language: str | None) -> str | None:
    """The text with each credential replaced and everything else as it was."""
    hits = dict(found(content, language))
    if not hits or content is None:
        return content
    lines = content.split("\n")
    out, in_key = [], False
    for no, line in enumerate(lines, 1):
        if in_key and not PRIVATE_END.search(line) and not KEY_BODY.match(line):
            in_key = False
        if in_key:
            if m := PRIVATE_END.search(line):
                in_key = False
                out.append(line[m.start() :])
            else:
                # one line of the key becomes one redacted line
                out.append(re.sub(r"[A-Za-z0-9+/=:, .-]+", REDACTED, line.rstrip("\r"), count=1) + ("\r" if line.endswith("\r") else ""))
            continue
        spans = hits.get(no)
        if not spans:
            out.append(line)
            continue
        if m := PRIVATE_BEGIN.search(line):
            end = PRIVATE_END.search(line, m.end())
            in_key = not end
            out.append(line if not end else line[: m.end()] + REDACTED + line[end.start() :])
            continue
        new, at = "", 0
        for a, b in spans:
            if a >= at:
                new += line[at:a] + REDACTED
                at = b
            elif b > at:
                at = b
        out.append(new + line[at:])
    return "\n".join(out)


# --- operators -------------------------------------------------------------------------------


def languages(files: DataFrame) -> DataFrame:
    newest = files.where("id is not null").groupBy(F.col("id").alias("file_id")).agg(F.max(F.struct("updated_at", "language", "path")).alias("f"))
    return newest.select("file_id", "f.language", "f.path")


def lines(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """(file_id, line_no) of every line that holds a credential."""

    def run(batches):
        for b in batches:
            rows = [(i, no) for i, g, t in zip(b["file_id"], b["language"], b["content"], strict=True) for no, _ in found(t, g)]
            yield pd.DataFrame(rows, columns=["file_id", "line_no"]).astype({"file_id": "int64", "line_no": "int32"})

    text = blobs.where("file_id is not null and content is not null").select("file_id", "content")
    return text.join(languages(files).select("file_id", "language"), "file_id", "left").mapInPandas(run, "file_id long, line_no int").dropDuplicates(["file_id", "line_no"])


def redacted(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """(file_id, content) of every text, with only the credentials replaced."""

    @F.pandas_udf("string")
    def clean(content: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([redact(t, g) for t, g in zip(content, language, strict=True)], dtype=object)

    text = blobs.where("file_id is not null").select("file_id", "content")
    return text.join(languages(files).select("file_id", "language"), "file_id", "left").select("file_id", clean("content", "language").alias("content"))
