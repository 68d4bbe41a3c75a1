"""Definitions, imports, roles, warnings and renderings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codelode.functions import notes
from codelode.operators import extract as x
from codelode.operators import graph as g
from codelode.operators import search
from codelode.plans import text_queries as t
from codelode.plans.graph_queries import MODULES
from codelode.plans.text_queries import BM, TOK, searched

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, tables: str, sql: str):
    def add(fn):
        t.query(name, tables, sql)(fn)
        QUERIES[name] = t.QUERIES.pop(name)
        if name in t.SQL:
            SQL[name] = t.SQL.pop(name)
        return fn

    return add


def texts(f, blobs):
    return blobs.select("file_id", "content").join(f.select(F.col("id").alias("file_id"), "path", "language"), "file_id")


def _definitions_sql() -> str:
    parts = []
    for kind, languages, pattern in x.DEFINITIONS:
        langs = ", ".join(f"'{v}'" for v in languages)
        parts.append(f"select file_id, '{kind}' as kind, unnest(regexp_extract_all(content, '{pattern}', 1)) as name from x where language in ({langs})")
    return ", x as (select b.file_id, b.content, f.language from file_blobs b join f on f.id = b.file_id) select distinct * from (" + " union all ".join(parts) + ")"


@query("x2_definitions", "f file_blobs", _definitions_sql())
def definitions(f, blobs):
    return x.definitions(texts(f, blobs))


@query("jn6_import_targets", "f file_blobs", "")
def import_targets(f, blobs):
    return x.import_targets(texts(f, blobs), f)


@query(
    "x4_imports", "f file_blobs",
    ", x as (select b.file_id, b.content, f.language from file_blobs b join f on f.id = b.file_id where f.language in ('typescript', 'tsx', 'javascript', 'jsx')) select file_id, count(*) as imports, count(distinct spec) as targets from (select file_id, unnest(regexp_extract_all(content, '" + x.IMPORT.replace("'", "''") + "', 1)) as spec from x) group by 1",
)
def imports(f, blobs):
    e = texts(f, blobs).where(F.col("language").isin(*x.SCRIPTS)).select("file_id", F.explode(F.regexp_extract_all("content", F.lit(x.IMPORT), 1)).alias("spec"))
    return e.groupBy("file_id").agg(F.count("*").alias("imports"), F.countDistinct("spec").alias("targets"))


#: The roles again, as SQL (fixed values).
WIKI_ROLE = """case when contains(lower(path), '.service.') then 'service' when contains(lower(path), '.controller.') then 'HTTP controller' when contains(lower(path), '.worker.') then 'worker' when contains(lower(path), '.cron.') then 'cron job'
when contains(lower(path), '.dto.') then 'DTO' when contains(lower(path), '.module.') then 'module' when contains(lower(path), '.guard.') then 'guard' when regexp_matches(lower(path), '\\.(tsx|jsx)$') then 'UI component'
when regexp_matches(lower(path), '(^|/)(index|main|app|server|cli)\\.[a-z]+$') then 'entry point' else 'file' end"""
BASE = "lower(split_part(path, '/', -1))"
CARD_ROLE = f"""case when contains({BASE}, '.service.') then 'service' when contains({BASE}, '.controller.') then 'HTTP controller (routes)' when contains({BASE}, '.worker.') then 'background worker' when contains({BASE}, '.cron.') then 'scheduled job (cron)'
when contains({BASE}, '.dto.') then 'data shapes (DTO)' when contains({BASE}, '.module.') then 'DI module' when contains({BASE}, '.guard.') then 'access guard' when contains({BASE}, '.resolver.') then 'resolver'
when regexp_matches(path, '(^|/)(index|main|app|server|cli)\\.[a-z]+$') then 'entry point' else 'module' end"""


@query("fn16_roles", "f", f"select id, {CARD_ROLE} as card_role, {WIKI_ROLE} as wiki_role from f")
def roles(f):
    return f.select("id", notes.card_role(F.col("path")).alias("card_role"), notes.wiki_role(F.col("path")).alias("wiki_role"))


@query("agg19_module_roles", "f", MODULES + f", r as (select mods.module, {WIKI_ROLE} as role, count(*) as files from mods group by 1, 2) select module, role, files from r qualify row_number() over (partition by module order by files desc, role) = 1")
def module_roles(f):
    """The dominant role of each module (AGG-19)."""
    n = f.select(g.module_of(F.col("path")).alias("module"), notes.wiki_role(F.col("path")).alias("role")).groupBy("module", "role").agg(F.count("*").alias("files"))
    return n.groupBy("module").agg(F.min(F.struct((-F.col("files")).alias("k"), "role")).alias("b")).select("module", "b.role", (-F.col("b.k")).alias("files"))


@query("x6_file_routes", "f s", "")
def file_routes(f, s):
    """Routes by the place of files and the names that they export (X-6)."""
    return x.routes(f, s.where("exported").groupBy("file_id").agg(F.collect_set("name").alias("names")))


@query(
    "agg20_module_notes", "f e m",
    MODULES + """, d as (select e.source_id as memory_id, e.target_id as file_id from e where edge_type = 'documents' and source_type = 'memory' and target_type = 'file'),
n as (select d.memory_id, count(*) as documented from d group by 1), h as (select d.memory_id, mods.module, count(*) as hits from d join mods on mods.id = d.file_id group by 1, 2)
select h.module, h.memory_id, h.hits, n.documented from h join n on n.memory_id = h.memory_id join m on m.id = h.memory_id where m.stale_status <> 'stale' and h.hits * 2 >= n.documented
qualify row_number() over (partition by h.module order by h.hits / n.documented desc, h.hits desc, h.memory_id) = 1""",
)
def module_notes(f, e, m):
    """The note that covers a module best, if half of what it documents lies there (AGG-20)."""
    d = e.where("edge_type = 'documents' and source_type = 'memory' and target_type = 'file'").select(F.col("source_id").alias("memory_id"), F.col("target_id").alias("file_id"))
    n = d.groupBy("memory_id").agg(F.count("*").alias("documented"))
    mod = f.select(F.col("id").alias("file_id"), g.module_of(F.col("path")).alias("module"))
    h = d.join(mod, "file_id").groupBy("memory_id", "module").agg(F.count("*").alias("hits")).join(n, "memory_id")
    ok = h.join(m.where("stale_status != 'stale'").select(F.col("id").alias("memory_id")), "memory_id", "left_semi").where("hits * 2 >= documented")
    w = Window.partitionBy("module").orderBy(F.desc(F.col("hits") / F.col("documented")), F.desc("hits"), "memory_id")
    return ok.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("module", "memory_id", "hits", "documented")


@query("agg23_naive_cost", "f file_blobs", ", x as (select array_to_string(string_split(f.path, '/')[1:2], '/') as repository, len(string_split(coalesce(b.content, ''), ' ')) as words from f join file_blobs b on b.file_id = f.id) select repository, count(*) as files, (round(sum(words) * 1.5) + 30 * count(*))::bigint as cost from x group by 1")
def naive_cost(f, blobs):
    """What reading a whole repository would cost (AGG-23), in words."""
    w = texts(f, blobs).select(F.substring_index("path", "/", 2).alias("repository"), F.size(F.split(F.coalesce("content", F.lit("")), " ")).alias("words"))
    return w.groupBy("repository").agg(F.count("*").alias("files"), (F.round(F.sum("words") * 1.5) + 30 * F.count("*")).cast("bigint").alias("cost"))


NOTE_TEXT = "title || ' ' || body || ' ' || array_to_string(tags, ' ')"


@query("flt16_warnings", "m eval_tasks", BM.format(tok=TOK.format(x=NOTE_TEXT), qtok=TOK.format(x="task"), src="m", k=15) + " select query_id, top.id, m.type from top join m on m.id = top.id where m.type in ('failed_attempt', 'known_issue') qualify row_number() over (partition by query_id order by place) <= 5")
def warnings(m, tasks):
    """Known problems among the best notes for a task, five at most (FLT-16)."""
    top = searched(m, F.concat_ws(" ", "title", "body", F.array_join("tags", " ")), tasks, 15).join(m.where("type in ('failed_attempt', 'known_issue')").select("id", "type"), "id")
    w = Window.partitionBy("query_id").orderBy("place")
    return top.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("query_id", "id", "type")


@query("fn20_skeletons", "s", "select file_id, string_agg(signature, chr(10) order by start_line, id) as skeleton from s where signature is not null group by 1")
def skeletons(s):
    """The signatures of each file in line order (FN-20)."""
    c = s.where("signature is not null").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", "signature"))).alias("a"))
    return c.select("file_id", F.array_join(F.transform("a", lambda r: r["signature"]), "\n").alias("skeleton"))


@query("set1_candidates", "s f m eval_tasks", "")
def candidates(s, f, m, tasks):
    """Candidate symbols of each task: lexical hits and the symbols of hit files (SET-1)."""
    a = searched(s, F.concat_ws(" ", "name", "qualified_name", "signature", "docstring"), tasks, 40).select("query_id", "id")
    b = searched(f, F.col("path"), tasks, 40).select("query_id", F.col("id").alias("file_id")).join(s.select("id", "file_id"), "file_id").select("query_id", "id")
    return a.unionByName(b).distinct()


@query("jn9_tested_by", "e s f", ", p as (select e.source_id as symbol_id, e.target_id as file_id, max(coalesce(confidence, 0)) as confidence from e where edge_type = 'tested_by' and source_type = 'symbol' and target_type = 'file' group by 1, 2) select p.symbol_id, f.path, p.confidence from p join f on f.id = p.file_id where p.symbol_id in (select id from s)")
def tested_by(e, s, f):
    p = e.where("edge_type = 'tested_by' and source_type = 'symbol' and target_type = 'file'").groupBy(F.col("source_id").alias("symbol_id"), F.col("target_id").alias("file_id")).agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    return p.join(s.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").join(f.select(F.col("id").alias("file_id"), "path"), "file_id").select("symbol_id", "path", "confidence")


@query("nrm3_vector_norms", "symbol_vectors", "select model_id, dim, count(*) as vectors, count(vector) as present, round(avg(case when len(vector) = dim and not list_contains(list_transform(vector, lambda v: isnan(v) or isinf(v)), true) then sqrt(list_dot_product(vector::double[], vector::double[])) end), 3) as norm from symbol_vectors group by 1, 2")
def vector_norms(v):
    fine = (F.size("vector") == F.col("dim")) & F.forall("vector", lambda y: ~F.isnan(y) & (F.abs(y) < float("inf")))
    return v.groupBy("model_id", "dim").agg(F.count("*").alias("vectors"), F.count("vector").alias("present"), F.round(F.avg(F.when(fine, F.sqrt(search.dot(F.col("vector"), F.col("vector"))))), 3).alias("norm"))
