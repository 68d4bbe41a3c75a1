"""Titles, sentences, references and small maps over notes, files and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.functions import notes as n
from codelode.functions import text as t
from codelode.functions import tokens
from codelode.operators import graph as g
from codelode.operators import maintain as mt
from codelode.plans import text_queries
from codelode.plans.text_queries import sub
from codelode.sources import walk

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, tables: str, sql: str):
    def add(fn):
        text_queries.query(name, tables, sql)(fn)
        QUERIES[name] = text_queries.QUERIES.pop(name)
        if name in text_queries.SQL:
            SQL[name] = text_queries.SQL.pop(name)
        return fn

    return add


# the look-ahead of the pattern becomes a character that is read over; found stays leftmost and longest
REF = r"((?:\.[A-Za-z0-9][A-Za-z0-9_@\-]*/)?[A-Za-z0-9_@][A-Za-z0-9_@.\-/]*\.(?:tsx|ts|jsx|mjs|cjs|js|py))(?:[^A-Za-z0-9]|$)"


@query(
    "fn7_note_refs", "m",
    f""", r as (select id, regexp_extract_all(body, '{REF}', 1) as a from m), u as (select id, list_filter(list_transform(range(1, len(a) + 1), lambda i: {{'v': a[i], 'first': list_position(a, a[i]) = i}}), lambda z: z.first and length(z.v) >= 5
and regexp_matches(split_part(z.v, '/', -1), '^[A-Za-z0-9]') and lower(z.v) not in ('next.js', 'node.js', 'nest.js', 'vue.js', 'three.js', 'express.js', 'react.js', 'nuxt.js')) as k from r) select id, array_to_string(list_transform(k, lambda z: z.v), ' ') as refs from u where len(k) > 0""",
)
def note_refs(m):
    """Code files that notes name, in order (FN-7)."""
    return m.select("id", t.code_refs(F.col("body")).alias("r")).where("size(r) > 0").select("id", F.array_join("r", " ").alias("refs"))


PROSE = r"""trim(regexp_replace(array_to_string(list_filter(list_transform(list_filter(list_transform(string_split({x}, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '' and not regexp_matches(l, '^(#|\||!\[|```|---|===|<!--)')),
lambda l: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '^>+\s*', ''), '^[-*+]\s+', ''), '^\d+\.\s+', ''), '\*\*', '', 'g'), '^_+', ''), '_+$', '')), lambda l: l <> ''), ' '), '\s+', ' ', 'g'))"""


@query(
    "fn12_quotes", "m",
    ", p as (select id, " + PROSE.replace("{x}", "body") + r""" as prose from m), q as (select id, prose, left(prose, 278) as head, trim(regexp_extract(left(prose, 278), '^(.*[.!?…])(\s|$)', 1)) as sentence from p)
select id, case when length(prose) <= 279 then prose when length(sentence) >= 278 / 3 then sentence else head end as quote from q""",
)
def quotes(m):
    """A quotation of each note (FN-12)."""
    return m.select("id", n.quote_from(F.col("body")).alias("quote"))


@query("fn12_sentences", "s", r", p as (select id, trim(regexp_replace(coalesce(docstring, ''), '\s+', ' ', 'g')) as one from s) select id, left(case when regexp_extract(one, '^(.+?[.!?])(\s|$)', 1) <> '' then regexp_extract(one, '^(.+?[.!?])(\s|$)', 1) else one end, 130) as sentence from p")
def sentences(s):
    return s.select("id", n.first_sentence(F.col("docstring")).alias("sentence"))


FRONT = r"regexp_extract(text, '(?s)\A---\r?\n(.*?)\r?\n---', 1)"
PLAIN = r"regexp_replace(text, '(?s)\A---\r?\n.*?\r?\n---[^\n]*(\r?\n|\z)', '')"


@query(
    "fn6_memory_titles", "documents",
    rf"""with x as (select doc_id, source, regexp_replace(regexp_extract({FRONT}, '(?m)^name:[^\S\n]*(.+?)\s*$', 1), '^["'']|["'']$', '', 'g') as name, trim(regexp_extract({PLAIN}, '(?m)^#[^\S\n]+(.+?)\s*$', 1)) as h1, regexp_extract({FRONT}, '(?m)^\s*type:\s*(user|feedback|project|reference)\s*$', 1) as told,
regexp_replace(split_part(source, '/', -1), '(.)\.[^.]*$', '\1') as base from documents where text is not null and kind in ('note', 'readme'))
select doc_id, coalesce(case when name <> '' then left(trim(name), 120) end, case when h1 <> '' then left(h1, 120) end, base) as title, case when told <> '' then told when regexp_extract(base, '^([^_-]*)', 1) in ('user', 'feedback', 'project', 'reference') then regexp_extract(base, '^([^_-]*)', 1) else '' end as type from x""",
)
def memory_titles(documents):
    """Titles and types of notes as agent memories have them (FN-6); the source stands for the file name."""
    d = documents.where("text is not null and kind in ('note', 'readme')")
    return d.select("doc_id", n.memory_title(F.col("text"), F.col("source")).alias("title"), n.memory_type(F.col("text"), F.col("source")).alias("type"))


@query("fn18_titles", "f", ", b as (select id, regexp_replace(split_part(path, '/', -1), '(.)\\.[^.]*$', '\\1') as base from f) select id, coalesce(nullif(array_to_string(" + sub("base") + ", ' '), ''), base) as title from b")
def titles(f):
    return f.select("id", n.humanised_title(F.col("path")).alias("title"))


@query("fn14_fences", "f", "select language, case when language in ('typescript', 'tsx') then 'ts' when language in ('javascript', 'jsx') then 'js' when language = 'python' then 'python' else '' end as fence, count(*) as files from f group by 1, 2")
def fences(f):
    return f.groupBy("language", n.fence_lang(F.col("language")).alias("fence")).agg(F.count("*").alias("files"))


@query(
    "fn22_model_texts", "symbol_vectors eval_tasks",
    """with v as (select distinct model_id from symbol_vectors union all select unnest(['multilingual-e5-small', 'Qwen3-Embedding-0.6B'])), k as (select model_id, case when contains(lower(model_id), 'qwen3') then 'qwen3' when contains(lower(model_id), 'e5') then 'e5' else 'generic' end as family from v)
select model_id, family, task_id, case family when 'e5' then 'query: ' || task when 'qwen3' then 'Instruct: Given a coding task in any language, retrieve the most relevant code.' || chr(10) || 'Query:' || task else task end as query, case family when 'e5' then 'passage: ' || passage else passage end as passage from k cross join eval_tasks where model_id is not null""",
)
def model_texts(vectors, tasks):
    """What each embedding model is given for a task and its passage (FN-22); the models are a handful."""
    more = vectors.sparkSession.createDataFrame([("multilingual-e5-small",), ("Qwen3-Embedding-0.6B",)], "model_id string")
    models = vectors.where("model_id is not null").select("model_id").distinct().unionByName(more).withColumn("family", n.embedding_family(F.col("model_id")))
    return tasks.crossJoin(F.broadcast(models)).select("model_id", "family", "task_id", n.query_text(F.col("family"), F.col("task")).alias("query"), n.passage_text(F.col("family"), F.col("passage")).alias("passage"))


@query("nrm13_confidence", "e s", ", c as (select target_id as id, source_id, max(coalesce(confidence, 0)) as confidence from e where edge_type = 'calls' and source_type = 'symbol' and target_type = 'symbol' and source_id in (select id from s) and target_id in (select id from s) group by 1, 2) select id, count(*) as callers, round(least(greatest(avg(confidence) * 0.9, 0), 1), 6) as confidence from c group by 1")
def confidence(e, s):
    """How sure the answer about the callers of a symbol is (NRM-13)."""
    return g.edge_hits(e, s, "source").groupBy(F.col("symbol_id").alias("id")).agg(F.count("*").alias("callers"), F.round(n.edge_confidence(F.avg("confidence")), 6).alias("confidence"))


@query("nrm8_symbol_hashes", "s", "select id, sha256(kind || '|' || qualified_name || '|' || coalesce(signature, '') || '|' || coalesce(docstring, '')) as hash from s")
def symbol_hashes(s):
    none = lambda c: F.coalesce(c, F.lit(""))
    return s.select("id", F.sha2(F.concat_ws("|", "kind", "qualified_name", none("signature"), none("docstring")), 256).alias("hash"))


@query("nrm9_note_tokens", "m", "")
def note_tokens(m):
    """Tokens of each note, for each family of models (NRM-9)."""
    return m.select("id", *[tokens.token_count(F.col("body"), f).alias(f) for f in tokens.RAISED])


@query("flt10_changed_files", "files", "with o as (select path, arg_min(hash, updated_at) as old from (select path, hash, updated_at from files where path is not null order by hash) group by 1), n as (select path, arg_max(hash, updated_at) as hash from (select path, hash, updated_at from files where path is not null order by hash desc) group by 1) select path, hash from n join o using (path) where old is null or old <> hash")
def changed_files(files):
    """Files whose newest version differs from the oldest one known (FLT-10)."""
    v = files.where("path is not null").groupBy("path").agg(F.min(F.struct("updated_at", "hash")).alias("a"), F.max(F.struct("updated_at", "hash")).alias("b"))
    return walk.changed(v.select("path", "b.hash"), v.select("path", "a.hash"))


@query("set3_vanished_files", "f file_blobs", " select id, path from f where id not in (select file_id from file_blobs where content is not null and file_id is not null)")
def vanished_files(f, blobs):
    """Known files of which no text was found: a set difference (SET-3, JN-16)."""
    found = f.join(blobs.where("content is not null").select(F.col("file_id").alias("id")), "id", "left_semi")
    return walk.vanished(found, f).select("id", "path")


@query("snk3_upsert_vectors", "symbol_vectors", "with v as (select distinct * from symbol_vectors), o as (select * from v qualify row_number() over (partition by symbol_id, model_id order by updated_at, source_hash) = 1), n as (select * from v qualify row_number() over (partition by symbol_id, model_id order by updated_at desc, source_hash desc) = 1) select symbol_id, model_id, n.source_hash, n.updated_at, o.updated_at as first from n join o using (symbol_id, model_id)")
def upsert_vectors(vectors):
    """The oldest row of each symbol and model, replaced by the newest (SNK-3)."""
    cols = ["symbol_id", "model_id", "source_hash", "updated_at"]
    v = vectors.select(*cols).withColumn("first", F.col("updated_at"))
    by = lambda f: v.groupBy("symbol_id", "model_id").agg(f(F.struct("updated_at", "source_hash", "first")).alias("r")).select("symbol_id", "model_id", "r.source_hash", "r.updated_at", "r.first")
    return mt.upsert(by(F.min), by(F.max), ["symbol_id", "model_id"], ["first"])


@query("jn7_resolved_calls", "e s", """, r as (select distinct e.source_id as caller_id, t.name from e join s t on t.id = e.target_id where edge_type = 'calls' and source_type = 'symbol' and target_type = 'symbol' and source_id in (select id from s)),
own as (select id, min(file_id) as file_id from s group by 1), i as (select distinct source_id as file_id, target_id from e where edge_type = 'imports' and source_type = 'file' and target_type = 'file'),
c as (select name, id, min(file_id) as file_id, min(case when kind in ('function', 'method', 'class') then 0 else 1 end) as rank from s where name in (select name from r) group by 1, 2), b as (select * from c qualify rank = min(rank) over (partition by name)),
n as (select *, count(*) over (partition by name) as candidates from b), top as (select * from n qualify row_number() over (partition by name order by id) <= 5)
select r.caller_id, r.name, top.id as target_id, (case when i.target_id is not null then 0.85 when candidates = 1 then 0.7 else 0.4 end)::double as confidence from r join top on top.name = r.name join own on own.id = r.caller_id left join i on i.file_id = own.file_id and i.target_id = top.file_id where r.caller_id <> top.id""")
def resolved_calls(e, s):
    """Calls resolved by name anew: imported files are surer, a symbol does not call itself (JN-7)."""
    called = g.calls(e).select(F.col("source_id").alias("caller_id"), F.col("target_id").alias("id")).join(s.select("id", "name"), "id").select("caller_id", "name").distinct()
    imported = g.imports(e).select(F.col("source_id").alias("file_id"), F.col("target_id").alias("target_file")).distinct()
    return g.resolve_calls(called, s, imported).select("caller_id", "name", "target_id", "confidence")
