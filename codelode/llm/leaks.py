"""Evaluation texts leaking into training text, by template canonicalisation.

Texts are reduced to words (runs of letters and digits, after undoing case, markup, invisible
characters, compatibility forms, combining marks and look-alike letters). Numbers, names and
units become typed placeholders; every window of SPAN // 2 words is hashed as a template with its
slot values aside. Document windows meet passage windows in a hash join on the template alone; per
document, passage and shift the windows are counted, and those with the passage's slot values
too. Slots tell the two kinds of hit apart: with equal ones the aligned texts are compared word
for word, and a document leaks a task when SPAN consecutive words of the passage stand in it, of
which at most one, inside, is replaced (one of the two halves of such a stretch has no replaced
word, so no case is lost); with other ones, consistent along SPAN words, the document asks the
passage again with other parameters (`variants`).

Defined results: null, empty and blank texts and passages shorter than SPAN words give no row;
repeated documents each give their rows, a repeated doc_id counts once; a very long text is a
stream of windows; ties do not arise (every task found is reported); extra columns are not
read; empty tables give no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import cut

#: Words that a leak has at least, and words of a template window.
SPAN = 12
WINDOW = SPAN // 2
#: Distinct passage templates that may be broadcast (8 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000

#: Letters of other scripts that look like Latin ones (fixed values).
LOOK_ALIKE = str.maketrans("абвгдеєзикмнорстухѕіјһԁԛԝүαβγεζηικνορτυχωıɡɑ", "a6brдeeзиkmhopctyxsijhdqwyaByezhikvoptuxwiga")
MARKUP = re.compile(r"</?(?:a|b|i|u|s|p|br|em|strong|code|pre|mark|span|div|li|ul|ol|td|tr|th|table|sup|sub|small|q|blockquote|h[1-6]|font|tt|kbd|del|ins)(?:\s[^<>]*)?/?>", re.I)
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
WORD = re.compile(r"[^\W_]+")
NUMBER = re.compile(r"\d+")
UNITS = frozenset("ms s sec seconds minute minutes min hour hours day days week weeks month months year years byte bytes kb mb gb tb percent ticks misses секунд секунды минут минуты дней дня часов тактов процентов".split())


@lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    """One form of a word for all its spellings."""
    w = unicodedata.normalize("NFKD", word).casefold()
    w = "".join(c for c in w if not unicodedata.combining(c))
    return w.translate(LOOK_ALIKE)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = MARKUP.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    return [fold(w) for w in WORD.findall(text)]


#: A word with a capital inside a sentence.
NAME = re.compile(r"(?<=[a-zа-я,;:] )[A-ZА-Я][^\W\d_]+")
#: Different names of all passages that may be held by every task.
MOST_NAMES = 200_000


def names_of(held: DataFrame) -> frozenset[str]:
    """Words that the passages write with a capital inside a sentence, gathered by Spark; only the different names,
    a checked number of them, reach the driver."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"name": sorted({fold(m[0]) for p in b["passage"] for m in NAME.finditer(p)})}, dtype=object)

    names = held.select("passage").mapInPandas(run, "name string").distinct().limit(MOST_NAMES + 1).collect()
    if len(names) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names in the held-out passages")
    return frozenset(r.name for r in names)


@lru_cache(maxsize=200_000)
def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) | 1


def kind(word: str, names: frozenset[str]) -> str:
    """The typed placeholder of a word, or the word."""
    if NUMBER.fullmatch(word):
        return "\x00number"
    if word in names:
        return "\x00name"
    return "\x00unit" if word in UNITS else word


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(WINDOW)], dtype=np.uint64)


def windows(tokens: list[str], names: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each window: the hash of its template and the hash of its slot values."""
    n = len(tokens) - WINDOW + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    typed = [kind(t, names) for t in tokens]
    t = np.array([_hash(x) for x in typed], dtype=np.uint64)
    s = np.array([_hash(x) if x is not y else 1 for x, y in zip(tokens, typed, strict=True)], dtype=np.uint64)
    template, slots = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        template += t[k : k + n] * _POWERS[k]
        slots += s[k : k + n] * _POWERS[WINDOW - 1 - k]
    return template.view(np.int64), slots.view(np.int64)


def template_windows(df: DataFrame, key: str, text: str, names: frozenset[str]) -> DataFrame:
    """(key, pos, template, slots) for every window of every text."""

    def run(batches):
        for b in batches:
            ids, pos, tem, slo = [], [], [], []
            for i, t in zip(b[key], b[text], strict=True):
                a, s = windows(words(t), names)
                if len(a):
                    ids.append(np.full(len(a), i, dtype=np.int64))
                    pos.append(np.arange(len(a), dtype=np.int32))
                    tem.append(a)
                    slo.append(s)
            if ids:
                yield pd.DataFrame({key: np.concatenate(ids), "pos": np.concatenate(pos), "template": np.concatenate(tem), "slots": np.concatenate(slo)})

    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} long, pos int, template long, slots long")


def bounded(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Marks `df` for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def stretch(doc: list[str], passage: list[str], shift: int) -> int:
    """The longest stretch of passage words that the document repeats at this shift (document position less
    passage position), of which at most one inside is replaced."""
    lo, hi = max(0, -shift), min(len(passage), len(doc) - shift)
    best = last = run = 0  # last: equal words before the latest replaced one
    for i in range(lo, hi):
        if passage[i] == doc[i + shift]:
            run += 1
        else:
            last, run = run, 0
        best = max(best, run + (last + 1 if last and run else 0))
    return best


def typed(word: str, names: frozenset[str]) -> bool:
    return kind(word, names) is not word


def template_hits(documents: DataFrame, held: DataFrame, names: frozenset[str], key: str, text: str) -> DataFrame:
    """(key, task_id, shift, windows, equal): documents that hold windows of a passage's template at one shift
    (document position less passage position), and how many of these have the passage's slot values."""
    wanted = template_windows(held, "task_id", "passage", names).select("task_id", F.col("pos").alias("at"), "template", F.col("slots").alias("other"))
    near = template_windows(documents, key, text, names).join(bounded(wanted), "template")
    equal = F.sum((F.col("slots") == F.col("other")).cast("int"))
    return near.groupBy(key, "task_id", (F.col("pos") - F.col("at")).alias("shift")).agg(F.count("*").alias("windows"), equal.alias("equal"))


def aligned(hits: DataFrame, documents: DataFrame, held: DataFrame, key: str, text: str, accept) -> DataFrame:
    """(key, task_id, n) of the best n > 0 that `accept` (document words, passage words, shift) gives for a hit.

    The hits of a document are one row, which is broadcast to the texts if their number allows it, so that no
    text moves; the passages come by task."""
    per = cut(hits.groupBy(key, "task_id").agg(F.collect_set("shift").alias("shifts")))
    found = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).join(bounded(per), key).join(bounded(held), "task_id")

    def run(batches):
        kept: dict = {}

        def of(x):
            if x not in kept:
                if len(kept) > 500:
                    kept.clear()
                kept[x] = words(x)
            return kept[x]

        for b in batches:
            best = [max(accept(d, p, int(s)) for s in shifts) for d, p, shifts in zip(map(words, b[text]), map(of, b["passage"]), b["shifts"], strict=True)]
            yield pd.DataFrame({key: b[key], "task_id": b["task_id"], "n": best}).query("n > 0")

    return found.select(key, "task_id", text, "passage", "shifts").mapInPandas(run, f"{key} long, task_id long, n long").groupBy(key, "task_id").agg(F.max("n").alias("n"))


def held_out(tasks: DataFrame) -> DataFrame:
    return tasks.where("task_id is not null and passage is not null").select(F.col("task_id").cast("long").alias("task_id"), "passage").distinct()


def leaks(documents: DataFrame, tasks: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, task_id) for every document that repeats `span` words of the passage of a task."""
    held = held_out(tasks)
    names = names_of(held)
    hits = template_hits(documents, held, names, key, text).where("equal > 0")
    return aligned(hits, documents, held, key, text, lambda d, p, s: int(stretch(d, p, s) >= span)).select(key, "task_id")


def varied(doc: list[str], passage: list[str], shift: int, names: frozenset[str], span: int = SPAN) -> int:
    """The words of the longest stretch of `span` or more at this shift whose words are the passage's or, in slots of the same
    type, others: at least one slot differs, no slot value stands for two, and half of the words are no slots; 0 if there is none."""
    best, begun = 0, max(0, -shift)
    there: dict = {}  # slot value of the passage: (that of the document, last place)
    changed = -1
    for at in range(begun, min(len(passage), len(doc) - shift)):
        p, d = passage[at], doc[at + shift]
        slot = typed(p, names)
        if p != d and not (slot and kind(p, names) == kind(d, names)):
            begun, changed = at + 1, -1
            there.clear()
            continue
        if slot:
            other = there.get(p)
            if other and other[0] != d:
                begun = max(begun, other[1] + 1)  # the stretch begins behind the contradiction
            there[p] = (d, at)
            if p != d:
                changed = at
        size = at + 1 - begun
        if changed >= begun and size >= span and size > best and 2 * sum(typed(w, names) for w in passage[begun : at + 1]) <= size:
            best = size
    return best


def variants(documents: DataFrame, tasks: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, task_id, words): documents that hold `span` words or more of a passage in a row with other numbers,
    names or units, the same one for the same, and do not hold the passage itself."""
    held = held_out(tasks)
    names = names_of(held)
    hits = template_hits(documents, held, names, key, text).where(f"windows > {WINDOW} and equal < windows")
    alike = aligned(hits, documents, held, key, text, lambda d, p, s: varied(d, p, s, names, span)).withColumnRenamed("n", "words")
    return alike.join(leaks(documents, tasks, key, text, span), [key, "task_id"], "left_anti")
