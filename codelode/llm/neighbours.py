"""Most similar vectors for every vector, by NN-descent over iterative Spark joins.

1. The current row of each (model, symbol) is taken and unusable vectors are left out.
2. Vectors of one direction form a class; one representative each enters the graph.
3. A first neighbour graph comes from several sortings of all vectors by cross-polytope codes of
   random rotations: each vector is compared with those next to it in every sorting. A sorting
   is a range partitioning, so a crowded region spreads over tasks and no group is collected.
   It moves one byte a number; its similarities only choose candidates and are not kept.
4. The candidates are compared on the whole vectors (four bytes a number, double precision).
5. NN-descent on the whole vectors: the neighbours of a vector (both directions) are brought
   together by joins and compared with each other, if one of them is new to it; better pairs
   enter the graph. Rounds go on until hardly an edge changes.

`search` finds the neighbours of any vectors by greedy walks over the finished graph, and
`exact_neighbours` compares every asked vector with all others, block by block, as the exact way
and as the measure of recall.

Defined results: a null, wrongly sized, non-finite or all-zero current vector makes the symbol
unusable, as does a null id or model; of equal updated_at values any one row counts (exact
repeats once); ties in similarity go to the smaller id; an empty table gives no rows; extra
columns are not read. Models and dimensions never meet. Members of a class beyond the
neighbours asked for are joined to its smallest ids, so a class of any size gives rows in
proportion to its members.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.leaks import bounded
from codelode.operators import search as core_search
from codelode.session import cut

#: Sortings for the first graph, rows compared together in a sorting, neighbours kept per vector.
SORTINGS = 5
BLOCK = 256
DEGREE = 20
#: Neighbours of a vector that meet in a round, in each direction, new ones first; the others wait for the next round.
MEETING = 10
#: At most so many members of one neighbourhood are compared in one group; a larger one (a hub)
#: is dealt out over several groups, anew in each round.
GROUP = 128
#: NN-descent ends when less than this share of the edges is new (the second where only close pairs are asked
#: for, whose graph is small), or after so many rounds.
STILL, STILL_CLOSE, ROUNDS = 0.01, 0.002, 12
#: How far below the threshold the one-byte search keeps a pair for the comparison of whole vectors.
COARSE = 0.02
#: Below every cosine: the mark of a vector met with itself, and what a list that is not full must beat.
SELF, LEAST = -2.0, -1.5


def newest(rows: DataFrame) -> DataFrame:
    """The row of the greatest updated_at for each symbol and model; of several, that of the greatest `same`."""
    w = Window.partitionBy("symbol_id", "model_id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("same").desc_nulls_last())
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def _pack(whole: bool):
    """same: a hash of the direction; q: the vector as bytes, four a number, scaled by a power of two so that
    nothing is rounded (whole), or one a number; both null for a vector that is of no use."""

    def run(batches):
        for b in batches:
            vec, dim = b.column("vector"), b.column("dim").to_pandas().to_numpy()
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            size = np.nan_to_num(vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
            start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
            q, same = np.full(len(size), None, dtype=object), np.full(len(size), None, dtype=object)
            for d in np.unique(size):
                at = np.flatnonzero((size == d) & (dim == d))
                if not d or not len(at):
                    continue
                x = flat[start[at][:, None] + np.arange(d)]
                fine = np.isfinite(x).all(1) & x.any(1)
                at, x = at[fine], x[fine]
                top = np.abs(x).max(1, keepdims=True)
                out = np.ldexp(x, -np.frexp(top)[1]).astype(np.float32) if whole else np.round(x / top * 127).astype(np.int8)
                x = x / top
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                r = np.round(x, 5).astype(np.float32) + np.float32(0)
                for k, row in enumerate(at):
                    q[row], same[row] = out[k].tobytes(), xxhash.xxh64_intdigest(r[k].tobytes()) - 2**63
            yield pa.RecordBatch.from_arrays([b.column("symbol_id"), b.column("model_id"), b.column("dim"), b.column("updated_at"), pa.array(same.tolist(), pa.int64()), pa.array(q.tolist(), pa.binary())], names=["symbol_id", "model_id", "dim", "updated_at", "same", "q"])

    return run


def packed(vectors: DataFrame, whole: bool) -> DataFrame:
    """(space, model_id, id, same, q) of every symbol with a usable current vector; space stands for model and
    dimension. The rows are packed first, so that choosing the current one moves bytes and not the original numbers."""
    rows = vectors.where("symbol_id is not null and model_id is not null").select(F.col("symbol_id").cast("long"), "model_id", F.col("dim").cast("int"), "updated_at", "vector")
    kind = rows.schema["updated_at"].dataType.simpleString()
    small = newest(rows.mapInArrow(_pack(whole), f"symbol_id long, model_id string, dim int, updated_at {kind}, same long, q binary"))
    return small.where("q is not null").select(F.xxhash64("model_id", "dim").alias("space"), "model_id", F.col("symbol_id").alias("id"), "same", "q")


def _unit(q, kind) -> np.ndarray:
    """Rows of length one: float32 from one-byte numbers, double from four-byte ones."""
    x = np.frombuffer(b"".join(q), dtype=kind).reshape(len(q), -1).astype(np.float32 if kind is np.int8 else np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _rotation(dim: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed * 1_000_003 + dim)
    return np.linalg.qr(r.standard_normal((dim, dim)))[0].astype(np.float32)


#: Cross-polytope hashes in one code.
HASHES = 4


def _codes(sorting: int):
    """Adds a code of HASHES cross-polytope hashes: the coordinate that a random rotation makes largest, with its sign."""

    def run(batches):
        for b in batches:
            code = np.zeros(len(b), dtype=np.int64)
            size = b["q"].str.len().to_numpy() if len(b) else np.zeros(0, dtype=int)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = _unit(b["q"].iloc[at].tolist(), np.int8)
                c = np.zeros(len(at), dtype=np.int64)
                for h in range(HASHES):
                    y = x @ _rotation(int(d), sorting * HASHES + h)
                    top = np.abs(y).argmax(1)
                    c = c * 4096 + (2 * top + (y[np.arange(len(y)), top] > 0)) % 4096
                code[at] = c
            yield pd.DataFrame({"space": b["space"], "code": code, "id": b["id"], "q": b["q"]})

    return run


LISTS = "space long, a long, b array<long>, sim array<double>"


def _nearest(space: int, ids, x, around, least: float) -> list[pd.DataFrame]:
    """The DEGREE nearest, of at least so much, of the rows around for each of the rows x."""
    others = np.concatenate([i for i, _ in around])
    sims = x @ np.vstack([y for _, y in around]).T
    sims[ids[:, None] == others[None, :]] = SELF
    if least > LEAST:
        some = np.flatnonzero(sims.max(1) >= least)
        if not len(some):
            return []
        ids, sims = ids[some], sims[some]
    k = min(DEGREE, len(others))
    top = np.argpartition(sims, len(others) - k, axis=1)[:, -k:]
    best = np.take_along_axis(sims, top, 1)
    if least <= LEAST:
        return [pd.DataFrame({"space": space, "a": ids, "b": list(others[top]), "sim": list(best.astype(np.float64))})]
    fit = best >= least
    return [pd.DataFrame({"space": space, "a": ids, "b": [others[t][f] for t, f in zip(top, fit, strict=True)], "sim": [s[f].astype(np.float64) for s, f in zip(best, fit, strict=True)]})]


def _windows(least: float):
    """Compares the rows of one sorted partition: each block with the one before, itself and the one behind."""

    def run(batches):
        space, held, ids, q = None, [], [], []

        def close():
            """Ends the block being filled."""
            nonlocal ids, q
            out = []
            if ids:
                held.append((np.array(ids, dtype=np.int64), _unit(q, np.int8)))
                ids, q = [], []
                if len(held) > 1:
                    out += _nearest(space, *held[-2], held, least)
                del held[:-2]
            return out

        def end():
            """Ends a space: the last block has none behind it."""
            out = close()
            if held:
                out += _nearest(space, *held[-1], held[-2:], least)
            held.clear()
            return out

        for pdf in batches:
            for s, i, v in zip(pdf["space"], pdf["id"], pdf["q"], strict=True):
                if s != space:
                    yield from end()
                    space = s
                elif len(ids) == BLOCK:
                    yield from close()
                ids.append(i)
                q.append(v)
        yield from end()

    return run


def top_edges(lists: DataFrame, k: int = DEGREE) -> DataFrame:
    """(space, a, b, sim): the k best different neighbours of each vector, from lists of them."""
    each = lists.repartition("space", "a").select("space", "a", F.explode(F.arrays_zip("b", "sim")).alias("e")).select("space", "a", "e.b", "e.sim").where(F.col("sim") > LEAST)
    return best_edges(each.groupBy("space", "a", "b").agg(F.max("sim").alias("sim")), k)


def best_edges(edges: DataFrame, k: int = DEGREE) -> DataFrame:
    w = Window.partitionBy("space", "a").orderBy(F.desc("sim"), "b")
    return edges.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def first_graph(nodes: DataFrame, least: float = LEAST, sortings: int = SORTINGS) -> DataFrame:
    """(space, a, b, sim) between neighbours in several sortings by cross-polytope codes; sim is rough."""
    out = None
    for s in range(sortings):
        coded = nodes.select("space", "id", "q").mapInPandas(_codes(s), "space long, code long, id long, q binary")
        near = coded.repartitionByRange("space", "code", "id").sortWithinPartitions("space", "code", "id").mapInPandas(_windows(least), LISTS)
        out = near if out is None else out.unionByName(near)
    return top_edges(out)


def _meet(batches):
    """Compares the members of each neighbourhood with each other, if one of the two is new to it; keeps what
    beats a member's worst neighbour.

    The rows come sorted by (space, hub, part); a neighbourhood has about GROUP members."""
    rest = None

    def compare(pdf):
        ids, worst, space, new = pdf["id"].to_numpy(), pdf["worst"].to_numpy(), pdf["space"].to_numpy(), pdf["new"].to_numpy(dtype=bool)
        key = pdf[["space", "hub", "part"]].to_numpy()
        start = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
        size = pdf["q"].str.len().to_numpy() // 4
        out = []
        q = pdf["q"].tolist()
        for d in np.unique(size):
            first = start[:-1][size[start[:-1]] == d]
            last = start[1:][size[start[:-1]] == d]
            at = np.flatnonzero(size == d)
            x = np.zeros((len(q), d))
            x[at] = _unit([q[i] for i in at], np.float32)
            for s, e in zip(first, last, strict=True):
                if e - s < 2:
                    continue
                sims = x[s:e] @ x[s:e].T
                i, j = np.nonzero((sims > worst[s:e, None]) & (new[s:e, None] | new[None, s:e]))
                keep = ids[s + i] != ids[s + j]
                if keep.any():
                    out.append((s + i[keep], s + j[keep], sims[i[keep], j[keep]]))
        if out:
            i, j, w = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pd.DataFrame({"space": space[i], "a": ids[i], "b": ids[j], "sim": w})

    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = pdf.iloc[-1]
        open_ = (pdf["space"] == last["space"]) & (pdf["hub"] == last["hub"]) & (pdf["part"] == last["part"])
        rest = pdf[open_]
        yield from compare(pdf[~open_].reset_index(drop=True)) if not open_.all() else ()
    if rest is not None:
        yield from compare(rest.reset_index(drop=True))


def _met(dealt: DataFrame, known: DataFrame) -> DataFrame:
    """(space, a, b, sim) of the better pairs within the neighbourhoods dealt: (space, hub, part, id, new)."""
    rows = dealt.join(known, ["space", "id"]).repartition("space", "hub", "part").sortWithinPartitions("space", "hub", "part")
    return rows.select("space", "hub", "part", "id", "q", "worst", "new").mapInPandas(_meet, "space long, a long, b long, sim double")


def compared(rough: DataFrame, whole: DataFrame, least: float = LEAST) -> DataFrame:
    """(space, a, b, sim, new): the candidates of a rough graph compared on the whole vectors, with what each
    vector's candidates are to each other; all edges are new."""
    own = F.lit(0).alias("part")
    dealt = rough.select("space", F.col("a").alias("hub"), own, F.col("b").alias("id"), F.lit(True).alias("new"))
    dealt = dealt.unionByName(rough.select("space", F.col("a").alias("hub"), own, F.col("a").alias("id"), F.lit(True).alias("new")).distinct())
    met = _met(dealt, whole.withColumn("worst", F.lit(float(least))))
    return best_edges(met.groupBy("space", "a", "b").agg(F.max("sim").alias("sim"))).withColumn("new", F.lit(True))


def descend(graph: DataFrame, whole: DataFrame, turn: int, least: float = LEAST) -> DataFrame:
    """One round of NN-descent: neighbours of each vector, in both directions, meet each other.

    The MEETING first edges of a vector take part, new ones before others; what took part is no longer new."""
    placed = graph.withColumn("rn", F.row_number().over(Window.partitionBy("space", "a").orderBy(F.desc("new"), F.desc("sim"), "b")))
    near = placed.where(F.col("rn") <= MEETING)
    both = near.select("space", F.col("a").alias("hub"), F.col("b").alias("id"), "new").unionByName(near.select("space", F.col("b").alias("hub"), F.col("a").alias("id"), "new"))
    hubs = both.groupBy("space", "hub").agg(F.count("*").alias("degree"), F.max("new").alias("any")).where("any").select("space", "hub", "degree")
    dealt = both.join(hubs, ["space", "hub"]).select("space", "hub", "id", "new", F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("degree") / GROUP)).alias("part"))
    worst = graph.groupBy("space", F.col("a").alias("id")).agg(F.when(F.count("*") >= DEGREE, F.min("sim")).otherwise(F.lit(float(least))).alias("worst"))
    known = whole.join(worst, ["space", "id"], "left").withColumn("worst", F.coalesce("worst", F.lit(float(least))))
    met = _met(dealt, known).withColumn("new", F.lit(True))
    stay = placed.select("space", "a", "b", "sim", (F.col("new") & (F.col("rn") > MEETING)).alias("new"))
    return best_edges(stay.unionByName(met).groupBy("space", "a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new")))


def settled(graph: DataFrame, whole: DataFrame, rounds: int = ROUNDS, least: float = LEAST) -> DataFrame:
    """The graph after rounds of NN-descent, until hardly an edge is new."""
    graph = cut(graph)
    for turn in range(rounds):
        seen = graph.agg(F.count("*").alias("edges"), F.count(F.when(F.col("new"), 1)).alias("new")).first()
        if seen.new <= (STILL if least <= LEAST else STILL_CLOSE) * seen.edges:
            break
        graph = cut(descend(graph, whole, turn, least))
    return graph.select("space", "a", "b", "sim")


def classes(small: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives (space, id, q), and members (space, rep, id) of classes of two or more."""
    of = small.groupBy("space", "same").agg(F.min(F.struct("id", "q")).alias("least"), F.count("*").alias("n"))
    many = of.where("n > 1").select("space", "same", F.col("least.id").alias("rep"))
    return of.select("space", "least.id", "least.q"), small.select("space", "same", "id").join(many, ["space", "same"]).drop("same")


def first_members(members: DataFrame, k: int) -> DataFrame:
    """The k smallest ids of each class; the limit works before the shuffle, so a huge class is no burden."""
    w = Window.partitionBy("space", "rep").orderBy("id")
    return members.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def expand(edges: DataFrame, members: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
    """(space, a, b, sim, direct): edges between representatives to edges between vectors. Each side of an edge
    stands for its class, of which the k + 1 smallest ids are enough as neighbours; within a class
    likewise. direct: both ends are the representatives that were compared. Neighbours are given for the members
    `asked` only, if that is given."""
    first = cut(first_members(members, k + 1))
    near = first.select("space", F.col("rep").alias("b"), F.col("id").alias("b2"))
    far = (members if asked is None else asked).select("space", F.col("rep").alias("a"), F.col("id").alias("a2"))
    own = far.join(near.withColumnRenamed("b", "a"), ["space", "a"]).select("space", F.col("a2").alias("a"), F.col("b2").alias("b"), F.lit(1.0).alias("sim"), F.lit(False).alias("direct"))
    direct = (F.coalesce("a2", "a") == F.col("a")) & (F.coalesce("b2", "b") == F.col("b"))
    out = edges.join(near, ["space", "b"], "left").join(far, ["space", "a"], "left").select("space", F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"), "sim", direct.alias("direct"))
    return out.unionByName(own).where("a != b")


def _cosines(batches):
    for b in batches:
        out = np.zeros(len(b))
        size = b["qa"].str.len().to_numpy() if len(b) else np.zeros(0, dtype=int)
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            out[at] = (_unit(b["qa"].iloc[at].tolist(), np.float32) * _unit(b["qb"].iloc[at].tolist(), np.float32)).sum(1)
        yield pd.DataFrame({"space": b["space"], "a": b["a"], "b": b["b"], "sim": out})


def exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(space, a, b, sim) on the whole vectors, in double precision."""
    v = whole_vectors(vectors, pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))).select("space", "id", "q")
    p = pairs.select("space", "a", "b").join(v.withColumnsRenamed({"id": "a", "q": "qa"}), ["space", "a"]).join(v.withColumnsRenamed({"id": "b", "q": "qb"}), ["space", "b"])
    return p.select("space", "a", "b", "qa", "qb").mapInPandas(_cosines, "space long, a long, b long, sim double")


def whole_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The whole vectors of the symbols named in the first column of `ids` (a checked number of them is broadcast)."""
    return packed(vectors.join(bounded(ids.toDF("symbol_id").distinct()), "symbol_id", "left_semi"), True)


def graph_of(vectors: DataFrame, least: float = LEAST, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, whole, nodes, members): the finished neighbour graph of the representatives, their whole
    vectors (of those with an edge), all of them in one-byte numbers, and the members of classes."""
    small = cut(packed(vectors, False))
    nodes, members = classes(small)
    nodes = cut(nodes)
    coarse = least - COARSE if least > LEAST else LEAST
    rough = cut(first_graph(nodes, coarse))
    ends = rough.select("space", "a").unionByName(rough.select("space", F.col("b").alias("a"))).distinct() if least > LEAST else nodes.select("space", F.col("id").alias("a"))
    # a symbol has a vector in several spaces; only those of the representatives of each are kept
    whole = cut(whole_vectors(vectors, ends.select("a")).join(ends.withColumnRenamed("a", "id"), ["space", "id"], "left_semi").select("space", "id", "q"))
    return settled(compared(rough, whole, least), whole, rounds, least), whole, nodes, members


def neighbours(vectors: DataFrame, k: int = 5, at_least: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(model_id, a, b, cosine, place): the k most similar other vectors b of every vector a, those
    of a cosine of at_least only, if that is given."""
    least = LEAST if at_least is None else at_least - 1e-4
    edges, _, _, members = graph_of(vectors, least, rounds)
    return ranked(expand(edges, members, k), vectors, k, at_least)


def ranked(pairs: DataFrame, vectors: DataFrame, k: int, at_least: float | None = None) -> DataFrame:
    """(model_id, a, b, cosine, place): the k best expanded pairs of every a, those not compared yet on the whole vectors."""
    # the few spaces there are: one for each model and dimension
    spaces = vectors.where("model_id is not null and dim is not null").select(F.xxhash64("model_id", F.col("dim").cast("int")).alias("space"), "model_id").distinct()
    pairs = cut(pairs)
    found = pairs.where("direct").select("space", "a", "b", "sim").unionByName(exact(pairs.where("not direct"), vectors))
    if at_least is not None:
        found = found.where(F.col("sim") >= at_least)
    w = Window.partitionBy("space", "a").orderBy(F.desc(F.round("sim", 9)), "b")
    best = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return best.join(bounded(spaces), "space").select("model_id", "a", "b", F.col("sim").alias("cosine"), "place")


def similar_pairs(vectors: DataFrame, k: int = 5, at_least: float = 0.9) -> DataFrame:
    """(model_id, symbol_id_a, symbol_id_b): pairs of which one is among the other's k most similar, smaller id first."""
    n = neighbours(vectors, k, at_least)
    return n.select("model_id", F.least("a", "b").alias("symbol_id_a"), F.greatest("a", "b").alias("symbol_id_b")).distinct()


# --- search ------------------------------------------------------------------------------------

#: Vectors kept in mind for each query, of which so many are left at once for their neighbours.
BEAM, LEAVES = 24, 3


def _near_query(batches):
    for b in batches:
        yield from (c.rename(columns={"a": "query", "b": "node"}) for c in _cosines([b.rename(columns={"query": "a", "node": "b"})]))


def search(queries: DataFrame, edges: DataFrame, whole: DataFrame, entries: DataFrame, k: int = 5) -> DataFrame:
    """(space, query, node, sim): the k most similar nodes of each query (space, query, q), by greedy walks.

    Every walk starts at the entries (space, query, node) of its query. In each step the best LEAVES
    vectors not yet left are left for their neighbours in the graph, both directions; the BEAM best seen are
    kept; a walk ends when all of them have been left. It does end: what falls behind the BEAM best stays behind."""
    back = Window.partitionBy("space", "b").orderBy(F.desc("sim"), "a")
    turned = edges.withColumn("rn", F.row_number().over(back)).where(F.col("rn") <= DEGREE).select("space", F.col("b").alias("node"), F.col("a").alias("next"))
    ways = cut(edges.select("space", F.col("a").alias("node"), F.col("b").alias("next")).unionByName(turned).distinct())
    asked = queries.select("space", "query", F.col("q").alias("qa"))
    own = whole.select("space", F.col("id").alias("node"), F.col("q").alias("qb"))

    def measured(met):
        return met.join(own, ["space", "node"]).join(asked, ["space", "query"]).select("space", "query", "node", "qa", "qb").mapInPandas(_near_query, "space long, query long, node long, sim double")

    best = Window.partitionBy("space", "query").orderBy(F.desc("sim"), "node")
    turn = Window.partitionBy("space", "query").orderBy("left", F.desc("sim"), "node")
    seen = cut(measured(entries.select("space", "query", "node").distinct()).withColumn("left", F.lit(False)))
    while True:
        kept = seen.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= BEAM).withColumn("turn", F.row_number().over(turn))
        going = kept.where(~F.col("left") & (F.col("turn") <= LEAVES))
        met = going.select("space", "query", "node").join(ways, ["space", "node"]).select("space", "query", F.col("next").alias("node")).distinct()
        fresh = met.join(kept.select("space", "query", "node"), ["space", "query", "node"], "left_anti")
        stay = kept.select("space", "query", "node", "sim", (F.col("left") | (F.col("turn") <= LEAVES)).alias("left"))
        seen = cut(stay.unionByName(measured(fresh).withColumn("left", F.lit(False))))
        if not seen.withColumn("rn", F.row_number().over(best)).where((F.col("rn") <= BEAM) & ~F.col("left")).limit(1).count():
            break
    return seen.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).select("space", "query", "node", "sim")


def searched(vectors: DataFrame, asked: str, k: int = 5) -> DataFrame:
    """(model_id, symbol_id, neighbour_id, cosine): the k most similar others of every usable vector that the
    condition `asked` on id chooses, by greedy search of the finished graph. Vectors of one direction walk once,
    and stand beside each other in the result. A walk starts at the candidates of a single sorting, as that of a
    new vector does."""
    edges, whole, nodes, members = graph_of(vectors)
    own = members.where(asked)
    chosen = whole.where(asked).select("space", "id").unionByName(own.select("space", F.col("rep").alias("id"))).distinct()
    queries = whole.join(chosen, ["space", "id"], "left_semi").select("space", F.col("id").alias("query"), "q")
    start = first_graph(nodes, sortings=1).join(queries.select("space", F.col("query").alias("a")), ["space", "a"], "left_semi")
    found = search(queries, edges, whole, start.select("space", F.col("a").alias("query"), F.col("b").alias("node")), k + 1)
    pairs = found.where("query != node").select("space", F.col("query").alias("a"), F.col("node").alias("b"), "sim")
    return ranked(expand(pairs, members, k, own), vectors, k).withColumnsRenamed({"a": "symbol_id", "b": "neighbour_id"})


def exact_neighbours(vectors: DataFrame, asked: str, k: int = 5) -> DataFrame:
    """(model_id, symbol_id, neighbour_id, cosine): the k most similar usable others of every usable symbol that
    the condition `asked` on symbol_id chooses, compared with all rows in blocks."""
    fine = packed(vectors, False).select("model_id", F.col("id").alias("symbol_id"))
    usable = vectors.join(fine, ["model_id", "symbol_id"], "left_semi")
    near = core_search.nearest(usable, F.expr(asked), k + 1).where("query_id != symbol_id")
    w = Window.partitionBy("model_id", "query_id").orderBy(F.desc("cosine"), "symbol_id")
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("model_id", F.col("query_id").alias("symbol_id"), F.col("symbol_id").alias("neighbour_id"), "cosine")


def recall(found: DataFrame, vectors: DataFrame, asked: str, k: int = 5) -> DataFrame:
    """(model_id, queries, wanted, hit, recall): how many of the exact k neighbours of the asked symbols `found`
    (model_id, symbol_id, neighbour_id, cosine) has; one as similar as the exact one (to five digits) counts."""
    want = exact_neighbours(vectors, asked, k)
    worst = want.groupBy("model_id", "symbol_id").agg(F.min("cosine").alias("worst"), F.count("*").alias("n"))
    hits = found.join(worst, ["model_id", "symbol_id"]).where(F.floor(F.col("cosine") * 1e5 + 0.5) / 1e5 >= F.col("worst")).groupBy("model_id", "symbol_id").agg(F.count("*").alias("hits"))
    each = worst.join(hits, ["model_id", "symbol_id"], "left").withColumn("hits", F.least(F.coalesce("hits", F.lit(0)), "n"))
    return each.groupBy("model_id").agg(F.count("*").alias("queries"), F.sum("n").alias("wanted"), F.sum("hits").alias("hit"), F.round(F.sum("hits") / F.sum("n"), 6).alias("recall"))
