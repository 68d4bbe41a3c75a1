"""Text functions, full-text and vector search over the graph tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codelode.functions import text as t
from codelode.operators import search
from codelode.operators import views as v
from codelode.operators.views import with_views
from codelode.sources import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, tables: str, sql: str):
    """Registers a query over views (f, s, e, m) and plain tables, with its SQL ("" for none)."""
    read = {"f": v.files, "s": v.symbols, "e": v.edges, "m": v.memories}

    def add(fn):
        QUERIES[name] = lambda spark, sf: fn(*[read[n](spark, sf) if n in read else read_table(spark, sf, n) for n in tables.split()])
        views = [n for n in tables.split() if n in read]
        if sql:
            SQL[name] = with_views(views, sql) if views and not sql.startswith(",") else (with_views(views, "")[:-1] + sql if views else sql)
        return fn

    return add


SUB = "list_transform(list_filter(list_transform(range(1, len({y}) + 1), lambda i: {{{{'w': {y}[i], 'first': list_position({y}, {y}[i]) = i}}}}), lambda z: z.first), lambda z: z.w)".format(y="list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}}+)(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), ' '), lambda w: length(w) >= 2), lambda w: lower(w))")


TOK = "list_filter(regexp_split_to_array(translate(lower({x}), '" + search.MARKED + "', '" + search.FOLDED + "'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def sub(x: str) -> str:
    return SUB.format(x=x)


@query("fn1_subtokens", "s", "select id, array_to_string(" + sub("name || ' ' || qualified_name") + ", ' ') as search_terms from s")
def subtokens(s):
    return s.select("id", F.array_join(t.subtokenize(F.col("name"), F.col("qualified_name")), " ").alias("search_terms"))


@query("fn3_terms", "m", "select w as term, count(*) as n, count(distinct id) as df from (select id, unnest(" + TOK.format(x="title || ' ' || body") + ") as w from m) group by 1")
def terms(m):
    """The vocabulary of the notes with document frequencies (FN-3, AGG-10)."""
    each = m.select("id", F.explode(search.tokens(F.concat_ws(" ", "title", "body"))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("id").alias("df"))


@query("flt7_languages", "f", "select id, coalesce(map {'.ts':'typescript','.mts':'typescript','.cts':'typescript','.tsx':'tsx','.js':'javascript','.mjs':'javascript','.cjs':'javascript','.jsx':'jsx','.py':'python','.pyi':'python'}[lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))], 'unknown') as language from f")
def languages(f):
    return f.select("id", t.language_of(F.col("path")).alias("language"))


@query("flt9_tests", "f", "select id, path, is_test from f where regexp_matches(path, '\\.(test|spec)\\.[tj]sx?$') or regexp_matches(path, '(^|/)tests?/') or regexp_matches(path, '(^|/)test_[^/]+\\.py$') or regexp_matches(path, '_test\\.py$')")
def tests(f):
    return f.where(t.is_test_path(F.col("path"))).select("id", "path", "is_test")


@query("flt14_languages_of_tasks", "eval_tasks", "select task_id, regexp_matches(task, '[а-яА-ЯёЁ]') and not regexp_matches(task, '[A-Za-z]{3}') as cyrillic_only from eval_tasks")
def languages_of_tasks(tasks):
    return tasks.select("task_id", t.asks_in_cyrillic(F.col("task")).alias("cyrillic_only"))


@query("nrm8_hashes", "file_blobs", "select file_id, sha256(content) as hash, substr(sha256(content), 1, 12) as short, case when content = '' then 0 else length(content) - length(replace(content, chr(10), '')) + 1 end as lines from file_blobs where content is not null")
def hashes(blobs):
    """Content hashes and line counts (NRM-8, NRM-11, SRC-2)."""
    return blobs.where("content is not null").select("file_id", F.sha2("content", 256).alias("hash"), t.short_hash(F.col("content")).alias("short"), t.line_count(F.col("content")).alias("lines"))


@query("fn10_signatures", "s", "select id, left(rtrim(regexp_replace(trim(split_part(signature, chr(10), 1)), '\\s*\\{$', '')), 200) as head from s where signature is not null")
def signatures(s):
    return s.where("signature is not null").select("id", t.first_line_signature(F.col("signature")).alias("head"))


@query("fn13_slugs", "m", "select id, lower(regexp_replace(regexp_replace(title, '[^\\p{L}\\p{N}]+', '-', 'g'), '^-|-$', '', 'g')) as slug from m")
def slugs(m):
    return m.select("id", t.slug(F.col("title")).alias("slug"))


@query("fn21_embedding_text", "s f", "select s.id, array_to_string(list_filter([f.path, s.qualified_name, s.signature, s.docstring], lambda x: x is not null and trim(x, ' ') <> ''), ' ' || chr(10) || ' ') as text from s left join f on f.id = s.file_id")
def embedding_text(s, f):
    p = f.select(F.col("id").alias("file_id"), "path")
    return s.join(p, "file_id", "left").select("id", t.embedding_text(F.col("path"), F.col("qualified_name"), F.col("signature"), F.col("docstring")).alias("text"))


@query("fn26_section_weights", "m", "select id, coalesce(map {'00':0.7,'01':1.4,'02':1.5,'03':1.3,'04':1.0,'05':0.6,'06':1.1,'13':1.1}[regexp_extract(coalesce(tags[2], ''), '^(\\d{2})', 1)], 1.0)::double as weight from m")
def section_weights(m):
    return m.select("id", t.section_weight(F.col("tags")).alias("weight"))


BM = """, d as (select id, {tok} as t from {src}), p as (select id, len(t) as dl, unnest(t) as term from d), tf as (select id, dl, term, count(*) as tf from p group by 1, 2, 3),
n as (select count(*) as n, avg(len(t)) as avgdl from d), df as (select term, count(*) as df from tf group by 1),
q as (select task_id as query_id, term, count(*) as qtf from (select task_id, unnest({qtok}) as term from eval_tasks) group by 1, 2),
hits as (select q.query_id, tf.id, -sum(qtf * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) as bm25 from tf join df on df.term = tf.term join q on q.term = tf.term cross join n group by 1, 2),
top as (select *, row_number() over (partition by query_id order by round(bm25, 9), id) as place from hits qualify place <= {k})"""


def searched(docs, text, tasks, k):
    q = tasks.select(F.col("task_id").alias("query_id"), F.explode(search.tokens(F.col("task"))).alias("term"))
    hits = search.bm25(docs, "id", text, q).withColumn("bm25", F.round("bm25", 9))
    return search.top(hits, "bm25", "id", k)


@query("sfts1_search_symbols", "s eval_tasks", BM.format(tok=TOK.format(x="concat_ws(' ', name, qualified_name, signature, docstring)"), qtok=TOK.format(x="task"), src="s", k=40) + " select query_id, id, place, round(round(bm25, 9), 6) as bm25 from top")
def search_symbols(s, tasks):
    """The forty best symbols for each task by BM25 over name, qualified name, signature and docstring."""
    return searched(s, F.concat_ws(" ", "name", "qualified_name", "signature", "docstring"), tasks, 40).select("query_id", "id", "place", F.round("bm25", 6).alias("bm25"))


@query("sfts2_search_files", "f eval_tasks", BM.format(tok=TOK.format(x="path"), qtok=TOK.format(x="task"), src="f", k=40) + " select query_id, id, place, round(round(bm25, 9), 6) as bm25 from top")
def search_files(f, tasks):
    return searched(f, F.col("path"), tasks, 40).select("query_id", "id", "place", F.round("bm25", 6).alias("bm25"))


@query("sfts3_search_notes", "m eval_tasks", BM.format(tok=TOK.format(x="title || ' ' || body || ' ' || array_to_string(tags, ' ')"), qtok=TOK.format(x="task"), src="m", k=30) + " select query_id, id, place, round(round(bm25, 9), 6) as bm25 from top")
def search_notes(m, tasks):
    return searched(m, F.concat_ws(" ", "title", "body", F.array_join("tags", " ")), tasks, 30).select("query_id", "id", "place", F.round("bm25", 6).alias("bm25"))


@query(
    "nrm2_note_scores", "m eval_tasks",
    BM.format(tok=TOK.format(x="title || ' ' || body || ' ' || array_to_string(tags, ' ')"), qtok=TOK.format(x="task"), src="m", k=10)
    + ", r as (select *, round(bm25, 9) as b from top) select query_id, id, round(case when max(b) over w = min(b) over w then 1.0 else (max(b) over w - b) / (max(b) over w - min(b) over w) end, 6) as score from r window w as (partition by query_id)",
)
def note_scores(m, tasks):
    """Notes for each task, BM25 scaled so that the best is 1 and the worst 0 (NRM-2)."""
    top = searched(m, F.concat_ws(" ", "title", "body", F.array_join("tags", " ")), tasks, 10)
    return top.select("query_id", "id", F.round(search.normalised_bm25(), 6).alias("score"))


@query(
    "sknow_knowledge", "m eval_tasks",
    BM.format(tok=TOK.format(x="title || ' ' || body || ' ' || array_to_string(tags, ' ')"), qtok=TOK.format(x="task"), src="m", k=30)
    + """, c as (select query_id, count(*) as n from top group by 1), w as (select id, title, coalesce(map {'00':0.7,'01':1.4,'02':1.5,'03':1.3,'04':1.0,'05':0.6,'06':1.1,'13':1.1}[regexp_extract(coalesce(tags[2], ''), '^(\\d{2})', 1)], 1.0) as weight, type in ('second_brain', 'generated_brain') as known from m),
q2 as (select task_id, list_distinct(list_filter(""" + sub("task") + """, lambda w: length(w) >= 3)) as q from eval_tasks)
select top.query_id, top.id, round((c.n - top.place + 1) * case when w.known then w.weight * case when len(q2.q) = 0 then 1.0 else 1.0 + len(list_intersect(list_filter(""" + sub("w.title") + """, lambda x: length(x) >= 3), q2.q)) / len(q2.q) end else 1.0 end, 6)::double as score
from top join c on c.query_id = top.query_id join w on w.id = top.id join q2 on q2.task_id = top.query_id""",
)
def knowledge(m, tasks):
    """Notes of each task, re-weighted by section and title (S-KNOW, FN-25..27)."""
    top = searched(m, F.concat_ws(" ", "title", "body", F.array_join("tags", " ")), tasks, 30)
    n = F.count("*").over(Window.partitionBy("query_id"))
    rows = top.withColumn("n", n).join(m.select("id", "title", "tags", "type"), "id").join(tasks.select(F.col("task_id").alias("query_id"), t.subtokenize(F.col("task")).alias("q")), "query_id")
    known = F.col("type").isin("second_brain", "generated_brain")
    factor = F.when(known, t.section_weight(F.col("tags")) * t.title_boost(F.col("title"), F.col("q"))).otherwise(1.0)
    return rows.select("query_id", "id", F.round((F.col("n") - F.col("place") + 1) * factor, 6).alias("score"))


@query(
    "svec_top_vectors", "symbol_vectors",
    """with v as (select * from (select * from symbol_vectors qualify row_number() over (partition by symbol_id, model_id order by updated_at desc) = 1) where vector is not null and len(vector) = dim and dim = 64 and model_id = 'minilex-64' and not list_contains(list_transform(vector, lambda x: isnan(x) or isinf(x)), true)),
q as (select vector as qv, symbol_id as query_id from v order by symbol_id limit 1)
select query_id, symbol_id, round(case when n = 0 then 0 else d / n end, 5) as cosine from (select query_id, symbol_id, list_dot_product(vector::double[], qv::double[]) as d, sqrt(list_dot_product(vector::double[], vector::double[]) * list_dot_product(qv::double[], qv::double[])) as n from v, q) order by cosine desc, symbol_id limit 40""",
)
def top_vectors(vectors):
    """The forty vectors nearest to one, for comparison with SQL; svec_all has every query (S-VEC, JN-17, TOP-2)."""
    w = Window.partitionBy("symbol_id", "model_id").orderBy(F.desc("updated_at"))
    v1 = vectors.where("model_id = 'minilex-64'").withColumn("rn", F.row_number().over(w)).where("rn = 1 and vector is not null and size(vector) = dim and dim = 64").where(F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))
    q = v1.orderBy("symbol_id").limit(1).select(F.col("symbol_id").alias("query_id"), F.col("vector").alias("qv"))
    # one row is broadcast
    met = v1.crossJoin(F.broadcast(q)).select("query_id", "symbol_id", F.round(search.cosine(F.col("vector"), F.col("qv")), 5).alias("cosine"))
    return met.orderBy(F.desc("cosine"), "symbol_id").limit(40)


@query("svec_all", "symbol_vectors", "")
def all_top_vectors(vectors):
    """The forty nearest vectors of its model for every current vector whose symbol_id is divisible by 20."""
    return search.nearest(vectors, F.col("symbol_id") % 20 == 0, 40)


@query("agg2_notes_by_type", "m", "select type, stale_status, count(*) as notes from m group by 1, 2")
def notes_by_type(m):
    return m.groupBy("type", "stale_status").agg(F.count("*").alias("notes"))


@query("fn15_dir_overlap", "f e", " select a.id as a, b.id as b, round(max(len(list_filter(range(1, least(len(x), len(y))), lambda i: x[1:i] = y[1:i])) / greatest(len(x) - 1, len(y) - 1, 1)), 6) as overlap from (select id, string_split(path, '/') as x from f) a join e on e.source_id = a.id and e.source_type = 'file' and e.target_type = 'file' and e.edge_type = 'imports' join (select id, string_split(path, '/') as y from f) b on b.id = e.target_id group by 1, 2")
def dir_overlap(f, e):
    """How near importing and imported files lie in the tree (FN-15, JN-15)."""
    i = e.where("edge_type = 'imports' and source_type = 'file' and target_type = 'file'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct()
    return i.join(f.select(F.col("id").alias("a"), F.col("path").alias("pa")), "a").join(f.select(F.col("id").alias("b"), F.col("path").alias("pb")), "b").select("a", "b", F.round(t.dir_overlap(F.col("pa"), F.col("pb")), 6).alias("overlap"))


@query("nrm5_churn_signal", "f", "select f.id, round(case when x.hi = x.lo then 0 else (git_churn - x.lo) / (x.hi - x.lo) end, 6)::double as churn from f, (select max(git_churn) as hi, min(git_churn) as lo from f) x")
def churn_signal(f):
    """Churn scaled over all files (NRM-1, NRM-5): the bounds are one row, joined back."""
    b = f.agg(F.max("git_churn").alias("hi"), F.min("git_churn").alias("lo"))
    return f.crossJoin(F.broadcast(b)).select("id", F.round(F.when(F.col("hi") == F.col("lo"), 0.0).otherwise((F.col("git_churn") - F.col("lo")) / (F.col("hi") - F.col("lo"))), 6).alias("churn"))
