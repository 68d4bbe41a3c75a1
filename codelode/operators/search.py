"""Full-text search with BM25 over an inverted index, vector search, and score normalisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.session import cut

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


#: Latin letters with marks and the letters they fold to (fixed values); Cyrillic letters keep theirs.
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
FOLDED = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case, Latin letters without their marks; '_' separates (FN-3)."""
    return F.filter(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, FOLDED), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, dl): the inverted index of the texts."""
    t = docs.select(F.col(key), tokens(text).alias("t"))
    t = t.select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return t.groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: Column, queries: DataFrame) -> DataFrame:
    """(query_id, key, bm25), lower is better, for every document that holds any token of a query.

    queries has query_id and term, repeated tokens count again. Idf is floored; document length
    is in tokens; the corpus totals are taken over all documents (AGG-10, NRM-4)."""
    all_ = docs.select(F.col(key), F.size(tokens(text)).alias("dl"))
    totals = all_.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = queries.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    mine = postings(docs, key, text).join(wanted.select("term").distinct(), "term", "left_semi")
    df = mine.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    # one row of corpus totals
    weight = df.crossJoin(F.broadcast(totals)).select("term", idf.alias("idf"), "avgdl")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return mine.join(weight, "term").join(wanted, "term").groupBy("query_id", key).agg((-F.sum(part)).alias("bm25"))


def top(hits: DataFrame, by: str, key: str, k: int, descending: bool = False) -> DataFrame:
    """The k best hits of each query, ties by key, with their place (TOP-1, WIN-1)."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by) if descending else F.asc(by), key)
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def normalised_bm25(col: str = "bm25", by: str = "query_id") -> Column:
    """Best hit 1, worst 0; all 1 when they are alike (NRM-2)."""
    w = Window.partitionBy(by)
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return F.when(F.col(col).isNull(), 0.0).when(hi == lo, 1.0).otherwise((hi - F.col(col)) / (hi - lo))


def min_max(col: str, by: list[str]) -> Column:
    """Scaled to 0..1 within its group; all 0 when they are alike (NRM-1)."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return F.when(hi == lo, 0.0).otherwise((F.col(col) - lo) / (hi - lo))


def scaled(rows: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Adds each new column: its old one scaled to 0..1 over all rows, all 0 when they are alike (NRM-1).

    The bounds are one row, found by one aggregation and joined back, so no task sees all rows."""
    b = rows.agg(*[f(c).alias(f"{n}_{new}") for new, c in cols.items() for n, f in (("lo", F.min), ("hi", F.max))])
    lo, hi = (lambda new: F.col(f"lo_{new}")), (lambda new: F.col(f"hi_{new}"))
    part = {new: F.when(hi(new) == lo(new), 0.0).otherwise((F.col(c) - lo(new)) / (hi(new) - lo(new))) for new, c in cols.items()}
    return rows.crossJoin(F.broadcast(b)).withColumns(part).drop(*b.columns)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 when either is all zero (NRM-3)."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


#: Queries and rows that are compared in one group.
QUERY_BLOCK, ROW_BLOCK = 4096, 16384


def current(vectors: DataFrame) -> DataFrame:
    """(symbol_id, model_id, dim, vector): the newest vector of every symbol and model, if it is of its dimension and finite."""
    w = Window.partitionBy("symbol_id", "model_id").orderBy(F.col("updated_at").desc_nulls_last())
    v = vectors.where("symbol_id is not null and model_id is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1 and vector is not null and dim > 0 and size(vector) = dim")
    return v.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select("symbol_id", "model_id", "dim", "vector")


def _compare(k: int):
    """The k best rows of one group for each of its queries, by rounded cosine, ties by id."""

    def unit(vectors) -> np.ndarray:
        x = np.array(vectors.tolist(), dtype=np.float64)
        top = np.abs(x).max(1, keepdims=True)
        x = x / np.where(top == 0, 1, top)
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(n == 0, 1, n)

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            rows = rows.sort_values("row_id")
            ids, x = rows["row_id"].to_numpy(), unit(rows["row"])
            n, m = len(ids), min(k, len(ids))
            back = np.arange(n)[::-1]
            for at in range(0, len(queries), 256):
                q = queries.iloc[at : at + 256]
                r = np.floor(unit(q["vector"]) @ x.T * 1e5 + 0.5).astype(np.int64)
                top = np.argpartition(r * n + back, n - m, axis=1)[:, n - m :]
                out.append(pd.DataFrame({"model_id": q["model_id"].repeat(m).to_numpy(), "query_id": q["symbol_id"].repeat(m).to_numpy(), "symbol_id": ids[top].ravel(), "cosine": np.take_along_axis(r, top, 1).ravel() / 1e5}))
        return pd.concat(out) if out else pd.DataFrame({"model_id": pd.Series(dtype=object), "query_id": pd.Series(dtype="int64"), "symbol_id": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})

    return run


def nearest(vectors: DataFrame, asked: Column, k: int) -> DataFrame:
    """(model_id, query_id, symbol_id, cosine): the k most similar current vectors of the same model
    and dimension for every current vector that is asked for, itself among them; exact.

    Queries and rows are dealt into blocks, and every block of queries meets every block of rows in
    a task of its own."""
    v = cut(current(vectors))
    # one row per model and dimension
    blocks = v.groupBy("model_id", "dim").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("rbs"), F.ceil(F.count(F.when(asked, 1).otherwise(None)) / QUERY_BLOCK).cast("int").alias("qbs")).where("qbs > 0")
    v = v.join(F.broadcast(blocks), ["model_id", "dim"])
    deal = lambda n: F.pmod(F.xxhash64("symbol_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["model_id", "dim", "qb", "rb", "symbol_id", "vector"]
    q = v.where(asked).withColumn("qb", deal("qbs")).withColumn("rb", each("rbs")).select(*cols)
    r = v.withColumn("rb", deal("rbs")).withColumn("qb", each("qbs")).select(*[F.col(c).alias(a) for c, a in zip(cols, ("m", "d", "q", "r", "row_id", "row"), strict=True)])
    met = q.groupBy(*cols[:4]).cogroup(r.groupBy("m", "d", "q", "r")).applyInPandas(_compare(k), "model_id string, query_id long, symbol_id long, cosine double")
    w = Window.partitionBy("model_id", "query_id").orderBy(F.desc("cosine"), "symbol_id")
    return met.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")
