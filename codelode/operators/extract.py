"""Definitions, imports and routes read out of source texts and paths."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCRIPTS = ("typescript", "tsx", "javascript", "jsx")
#: Definitions at the start of a line: kind, languages, pattern with the name as its group.
DEFINITIONS = [
    ("function", ("python",), r"(?m)^\s*(?:async\s+)?def\s+(\w+)\s*\("),
    ("class", ("python",), r"(?m)^\s*class\s+(\w+)"),
    ("function", SCRIPTS, r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
    ("class", SCRIPTS, r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("interface", ("typescript", "tsx"), r"(?m)^\s*(?:export\s+)?interface\s+(\w+)"),
    ("type", ("typescript", "tsx"), r"(?m)^\s*(?:export\s+)?type\s+(\w+)\s*[=<]"),
]


def definitions(texts: DataFrame) -> DataFrame:
    """(file_id, kind, name) of every definition, each once; texts has file_id, language, content (X-2, X-3)."""
    out = None
    for kind, languages, pattern in DEFINITIONS:
        part = texts.where(F.col("language").isin(*languages)).select("file_id", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(pattern), 1)).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


#: Relative imports of scripts.
IMPORT = r"(?m)^\s*(?:import|export)\b[^;\n]*?[\"'](\.[^\"'\n]*)[\"']"
#: Endings tried behind an import, in order (fixed values).
ENDINGS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")


def joined(folder: Column, spec: Column) -> Column:
    """folder and relative spec as one normal path; '..' takes a folder away."""
    parts = F.filter(F.split(F.concat(folder, F.lit("/"), spec), "/"), lambda p: (p != ".") & (p != ""))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1)).otherwise(a)), "/")


def import_targets(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, spec, target_id) of the relative imports of scripts (X-4, JN-6): of the candidate paths the
    first that is a file wins; null where none is. texts has file_id, path, language, content."""
    specs = texts.where(F.col("language").isin(*SCRIPTS)).select("file_id", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(IMPORT), 1))).alias("spec"))
    full = specs.withColumn("full", joined(F.col("folder"), F.col("spec"))).withColumn("bare", F.regexp_replace("full", r"\.(js|jsx|mjs|cjs|ts|tsx|mts|cts)$", ""))
    tries = F.array(F.col("full"), *[F.concat(F.col(c), F.lit(s + e)) for s in ("", "/index") for c in ("bare", "full") for e in ENDINGS])
    each = full.select("file_id", "spec", F.posexplode(tries).alias("place", "path"))
    hit = each.join(files.select("path", F.col("id").alias("target_id")), "path").groupBy("file_id", "spec").agg(F.min_by("target_id", "place").alias("target_id"))
    return specs.select("file_id", "spec").join(hit, ["file_id", "spec"], "left")


VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def file_routes(path: str, exported: list[str]) -> list[tuple[str, str]]:
    """(method, address) of a file whose place is its route (X-6): an `app` folder with page and route
    files, or `app/routes` with one file a route."""
    seg = path.split("/")
    name = seg[-1]
    m = re.fullmatch(r"(.+)\.(tsx?|jsx?|mjs|mts)", name)
    if not m:
        return []
    base = m[1]
    if base.endswith(".d"):
        return []
    at = max((i for i, s in enumerate(seg[:-1]) if s == "app"), default=-1)
    if at >= 0 and len(seg) > at + 2 and seg[at + 1] == "routes":
        parts = seg[at + 2 : -1] + [base]
        if base.startswith("__") or re.search(r"\.(server|client|test|spec)$", base) or any(p.startswith("+") for p in parts[:-1]):
            return []
        words: list[str] = []
        for k, part in enumerate(parts):
            part = part[:-1] if k < len(parts) - 1 and part.endswith("+") else part
            words += [w for w in re.split(r"\.(?![^\[]*\])", part)]
        if words and words[-1] == "route":
            words.pop()
        address = []
        for w in words:
            if w.startswith("_") or w == "index":
                continue
            w = w[:-1] if w.endswith("_") else w
            w = re.sub(r"\[(.*?)\]", r"\1", w)
            address.append("*" if w == "$" else ":" + w[1:] if w.startswith("$") else w)
        out = "/" + "/".join(address)
        return [("GET", out)] + ([("POST", out)] if "action" in exported else [])
    if at < 0 or base not in ("page", "route"):
        return []
    address = []
    for s in seg[at + 1 : -1]:
        if s[0] in "@_" or s.startswith(("(.)", "(..)", "(...)")):
            return []
        if s.startswith("(") and s.endswith(")"):
            continue
        s = re.sub(r"^\[\[\.\.\.(.+)\]\]$", r"*\1?", s)
        s = re.sub(r"^\[\.\.\.(.+)\]$", r"*\1", s)
        address.append(re.sub(r"^\[(.+)\]$", r":\1", s))
    out = "/" + "/".join(address)
    if base == "page":
        return [("GET", out)] if m[2] in ("tsx", "jsx", "ts", "js") else []
    return [(v, out) for v in VERBS if v in exported]


def routes(files: DataFrame, exported: DataFrame) -> DataFrame:
    """(file_id, method, address) by place; exported has file_id and names."""

    @F.pandas_udf("array<struct<method:string,address:string>>")
    def of(path: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([[{"method": m, "address": a} for m, a in file_routes(p or "", list(n) if n is not None else [])] for p, n in zip(path, names, strict=True)], dtype=object)

    # only files in such folders reach the Python helper
    near = files.where(F.col("path").rlike(r"(^|/)app/(.*/)?(page|route)\.[tj]sx?$|(^|/)app/routes/"))
    return near.select(F.col("id").alias("file_id"), "path").join(exported, "file_id", "left").select("file_id", F.explode(of("path", "names")).alias("r")).select("file_id", "r.method", "r.address")
