"""Lookups, joins, roll-ups and set operations over the graph tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import graph as g
from codelode.operators import views as v
from codelode.operators.views import with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, names: str, sql: str):
    """Registers a query over the views f, s, e, m in `names` together with its SQL."""
    read = {"f": v.files, "s": v.symbols, "e": v.edges, "m": v.memories}

    def add(fn):
        QUERIES[name] = lambda spark, sf: fn(*[read[n](spark, sf) for n in names])
        SQL[name] = with_views(names, sql) if not sql.lstrip().startswith(",") else with_views(names, "")[:-1] + sql
        return fn

    return add


@query("src11_symbols_by_file", "s", "select file_id, id, name, kind, start_line, row_number() over (partition by file_id order by start_line, id) as place from s")
def symbols_by_file(s):
    """All symbols, in line order within their file (SRC-11, FLT-2)."""
    from pyspark.sql import Window

    return s.select("file_id", "id", "name", "kind", "start_line", F.row_number().over(Window.partitionBy("file_id").orderBy("start_line", "id")).alias("place"))


@query("src12_edges_for_ranking", "e", "select source_type, source_id, target_type, target_id, edge_type, confidence from e")
def edges_for_ranking(e):
    return e.select("source_type", "source_id", "target_type", "target_id", "edge_type", "confidence")


@query("flt1_files_by_path", "fm", "select distinct f.id, f.path, f.language from f join (select unnest(related_files) as path from m) r on r.path = f.path")
def files_by_path(f, m):
    """Point lookups by path, for all paths that notes name (FLT-1)."""
    return f.join(m.select(F.explode("related_files").alias("path")).distinct(), "path", "left_semi").select("id", "path", "language")


@query("flt3_symbols_by_name", "sm", "select id, name, kind, file_id from s where name in (select unnest(related_symbols) from m) and kind in ('function', 'method')")
def symbols_by_name(s, m):
    return s.where("kind in ('function', 'method')").join(m.select(F.explode("related_symbols").alias("name")).distinct(), "name", "left_semi").select("id", "name", "kind", "file_id")


@query("flt4_edges_of_files", "fe", "select f.id as file_id, count(*) filter (where e.source_type = 'file' and e.source_id = f.id) as edges_from, count(*) filter (where e.target_type = 'file' and e.target_id = f.id) as edges_to from f join (select *, source_id as k from e where source_type = 'file' union all select *, target_id as k from e where target_type = 'file' and not (source_type = 'file' and source_id = target_id)) e on e.k = f.id group by f.id")
def edges_of_files(f, e):
    """How many edges leave and reach each file (FLT-4)."""
    out = e.where("source_type = 'file'").groupBy(F.col("source_id").alias("file_id")).agg(F.count("*").alias("edges_from"))
    to = e.where("target_type = 'file'").groupBy(F.col("target_id").alias("file_id")).agg(F.count("*").alias("edges_to"))
    both = out.join(to, "file_id", "full").select("file_id", F.coalesce("edges_from", F.lit(0)).alias("edges_from"), F.coalesce("edges_to", F.lit(0)).alias("edges_to"))
    return both.join(f.select(F.col("id").alias("file_id")), "file_id", "left_semi")


@query("flt15_knowledge_notes", "m", "select id, type, title, stale_status from m where type in ('second_brain', 'generated_brain')")
def knowledge_notes(m):
    return m.where(F.col("type").isin("second_brain", "generated_brain")).select("id", "type", "title", "stale_status")


@query("jn2_symbol_places", "sf", "select s.id, s.qualified_name, coalesce(f.path, '?') as path from s left join f on f.id = s.file_id")
def symbol_places(s, f):
    return g.symbol_places(s, f).select("id", "qualified_name", "path")


HITS = """, c as (select {o}_id as symbol_id, {e}_id as hit_id, coalesce(confidence, 0) as confidence, id as edge_id from e where edge_type = 'calls' and source_type = 'symbol' and target_type = 'symbol')
select c.symbol_id, c.hit_id, h.name as hit_name, c.confidence, c.edge_id from c join s h on h.id = c.hit_id where c.symbol_id in (select id from s)
qualify row_number() over (partition by c.symbol_id, c.hit_id order by c.confidence desc, c.edge_id) = 1"""


@query("jn3_callers", "es", HITS.format(o="target", e="source"))
def callers(e, s):
    return g.edge_hits(e, s, "source")


@query("jn3_callees", "es", HITS.format(o="source", e="target"))
def callees(e, s):
    return g.edge_hits(e, s, "target")


@query("jn4_imports", "ef", "select e.id as edge_id, a.path as importer, b.path as imported from e join f a on a.id = e.source_id join f b on b.id = e.target_id where edge_type = 'imports' and source_type = 'file' and target_type = 'file'")
def imported_by(e, f):
    return g.imported_by(e, f)


@query(
    "jn5_impact", "esf",
    """, hits as (
  select s.id as symbol_id, e.source_id as hit_file, 1 as why from s join e on e.target_id = s.file_id where e.edge_type = 'imports' and e.source_type = 'file' and e.target_type = 'file'
  union all select e.source_id, e.target_id, 2 from e where edge_type = 'tested_by' and source_type = 'symbol' and target_type = 'file' and source_id in (select id from s)
  union all select e.target_id, s.file_id, 3 from e join s on s.id = e.source_id where edge_type = 'calls' and source_type = 'symbol' and target_type = 'symbol' and e.target_id in (select id from s))
select h.symbol_id, f.path, min(h.why) as why from hits h join f on f.id = h.hit_file group by h.symbol_id, h.hit_file, f.path""",
)
def impact(e, s, f):
    return g.impact(e, s, f)


@query(
    "jn8_enclosing_symbols", "es",
    """, l as (select distinct file_id, line from e where file_id is not null and line is not null and edge_type in ('calls', 'tested_by'))
select l.file_id, l.line, s.id as symbol_id from l join s on s.file_id = l.file_id and s.start_line <= l.line and l.line <= s.end_line
qualify row_number() over (partition by l.file_id, l.line order by s.start_line desc, s.id) = 1""",
)
def enclosing_symbols(e, s):
    """The innermost symbol around the line of each call: a range join per file."""
    lines = e.where("file_id is not null and line is not null and edge_type in ('calls', 'tested_by')").select("file_id", "line").distinct()
    return g.enclosing(lines, s)


@query(
    "jn7_name_targets", "sm",
    """, r as (select distinct unnest(related_symbols) as name from m), c as (select s.name, s.id, case when kind in ('function', 'method', 'class') then 0 else 1 end as rank from s where name in (select name from r)),
b as (select c.* from c join (select name, min(rank) as rank from c group by name) x on x.name = c.name and x.rank = c.rank), n as (select name, count(*) as candidates from b group by name)
select b.name, b.id as target_id, n.candidates, (case when n.candidates = 1 then 0.7 else 0.4 end)::double as confidence from b join n on n.name = b.name qualify row_number() over (partition by b.name order by b.id) <= 5""",
)
def name_targets(s, m):
    """Symbols that a mentioned name may mean, the first five of each (JN-7, WIN-2)."""
    return g.resolve_names(m.select(F.explode("related_symbols").alias("name")).distinct(), s)


SUFFIX = """, x as (select id as file_id, path, string_split(path, '/') as seg from f),
suf as (select file_id, array_to_string(seg[i:], '/') as suffix, i = 1 as whole from (select file_id, seg, unnest(range(1, len(seg) + 1)) as i from x))"""


@query(
    "jn10_note_links", "mf",
    SUFFIX + """, r as (select distinct id as memory_id, unnest(related_files) as suffix from m),
o as (select memory_id, r.suffix, min(struct_pack(partial := not whole, file_id := file_id)) as b from r join suf on suf.suffix = r.suffix where whole or contains(r.suffix, '/') group by 1, 2)
select memory_id, b.file_id as file_id, max(case when b.partial then 0.8 else 1.0 end)::double as confidence from o group by 1, 2""",
)
def note_links(m, f):
    return g.note_links(m, f)


@query("jn11_dead_references", "mf", SUFFIX + " select distinct memory_id, ref from (select id as memory_id, unnest(related_files) as ref from m) where contains(ref, '/') and ref not in (select suffix from suf)")
def dead_references(m, f):
    return g.dead_references(m, f)


@query(
    "jn12_mentioned_symbols", "sfm",
    " select distinct s.id from s left join f on f.id = s.file_id where f.path in (select unnest(related_files) from m) or s.name in (select unnest(related_symbols) from m) or s.qualified_name in (select unnest(related_symbols) from m)",
)
def mentioned_symbols(s, f, m):
    return g.mentioned(s, f, m)


@query("jn13_notes_of_files", "em", "select e.target_id as file_id, m.id as memory_id, m.title from e join m on m.id = e.source_id where e.edge_type = 'documents' and e.source_type = 'memory' and e.target_type = 'file'")
def notes_of_files(e, m):
    d = e.where("edge_type = 'documents' and source_type = 'memory' and target_type = 'file'").select(F.col("target_id").alias("file_id"), F.col("source_id").alias("id"))
    return d.join(m.select("id", "title"), "id").select("file_id", F.col("id").alias("memory_id"), "title")


@query(
    "jn14_neighbours", "sem",
    """, seed as (select id from s where name in (select unnest(related_symbols) from m)), x as (select source_id as a, target_id as b from e where source_type = 'symbol' and target_type = 'symbol')
select distinct id from (select b as id from x where a in (select id from seed) union all select a from x where b in (select id from seed))""",
)
def neighbours(s, e, m):
    seeds = s.join(m.select(F.explode("related_symbols").alias("name")).distinct(), "name", "left_semi").select("id")
    return g.neighbours(seeds, e)


DEGREES = """, d as (select f.id, f.path, f.language, coalesce(x.n, 0) as symbols, coalesce(y.n, 0) as importers from f left join (select file_id, count(*) as n from s group by 1) x on x.file_id = f.id
left join (select target_id, count(*) as n from e where edge_type = 'imports' and source_type = 'file' and target_type = 'file' group by 1) y on y.target_id = f.id)"""


@query("agg4_languages", "f", "select language, count(*) as files from f group by 1")
def languages(f):
    return f.groupBy("language").agg(F.count("*").alias("files"))


@query("agg5_modules", "f", "select array_to_string(string_split(path, '/')[1:2], '/') as module, count(*) as files from f group by 1")
def modules(f):
    return f.groupBy(F.substring_index("path", "/", 2).alias("module")).agg(F.count("*").alias("files"))


@query("agg6_degrees", "esf", DEGREES + " select id, path, language, symbols, importers from d")
def degrees(e, s, f):
    return g.degrees(e, s, f)


@query("agg7_entry_points", "esf", DEGREES + " select id, path from d where importers = 0 and symbols > 0 order by id limit 10")
def entry_points(e, s, f):
    return g.degrees(e, s, f).where("importers = 0 and symbols > 0").orderBy("id").select("id", "path").limit(10)


@query("agg8_god_files", "esf", DEGREES + " select id, path, symbols + 2 * importers as weight from d order by weight desc, id limit 5")
def god_files(e, s, f):
    return g.degrees(e, s, f).select("id", "path", (F.col("symbols") + 2 * F.col("importers")).alias("weight")).orderBy(F.desc("weight"), "id").limit(5)


@query("agg12_note_fanout", "e", "select source_id as memory_id, target_id as file_id, max(coalesce(confidence, 0)) / sqrt(max(n)) as weight from (select *, count(*) over (partition by source_id) as n from e where edge_type = 'documents' and source_type = 'memory' and target_type = 'file') group by 1, 2")
def note_fanout(e):
    """A note that documents many files says less about each (AGG-12)."""
    d = e.where("edge_type = 'documents' and source_type = 'memory' and target_type = 'file'")
    n = d.groupBy("source_id").agg(F.count("*").alias("n"))
    best = d.groupBy("source_id", "target_id").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("c"))
    return best.join(n, "source_id").select(F.col("source_id").alias("memory_id"), F.col("target_id").alias("file_id"), (F.col("c") / F.sqrt("n")).alias("weight"))


@query("agg14_out_weights", "e", ", r as (select source_type, source_id, greatest(coalesce(confidence, 0), 0.05) as w from e where source_type in ('symbol', 'file') and target_type in ('symbol', 'file') union all select target_type, target_id, 0.5::double from e where edge_type = 'defines' and source_type in ('symbol', 'file') and target_type in ('symbol', 'file')) select substr(source_type, 1, 1) || source_id as node, round(sum(w), 6) as weight from r group by 1")
def out_weights(e):
    return g.ranking_edges(e).groupBy(F.col("src").alias("node")).agg(F.round(F.sum("weight"), 6).alias("weight"))


CONT = "('modules', 'packages', 'lib', 'src', 'app', 'features', 'services')"
MODULE = f"""(case when len(seg) = 1 then '(root)' when len(seg) = 2 then seg[1] else array_to_string(seg[1:greatest(1, case when k > 0 then least(len(seg) - 1, k + 1) else 2 end)], '/') end)"""
MODULES = f""", x as (select id, path, string_split(path, '/') as seg from f), y as (select *, coalesce(list_max(list_filter(range(1, len(seg)), lambda i: lower(seg[i]) in {CONT})), 0) as k from x), mods as (select id, path, {MODULE} as module from y)"""


@query("fn17_modules", "f", MODULES + " select id, module from mods")
def module_of(f):
    return f.select("id", g.module_of(F.col("path")).alias("module"))


@query(
    "agg18_module_imports", "ef",
    MODULES + " select a.module as module, b.module as imported, count(*) as imports from e join mods a on a.id = e.source_id join mods b on b.id = e.target_id where edge_type = 'imports' and source_type = 'file' and target_type = 'file' and a.module <> b.module group by 1, 2",
)
def module_imports(e, f):
    """Import edges between modules (AGG-18)."""
    m = f.select("id", g.module_of(F.col("path")).alias("module"))
    i = g.imports(e).select("source_id", "target_id")
    a, b = m.select(F.col("id").alias("source_id"), "module"), m.select(F.col("id").alias("target_id"), F.col("module").alias("imported"))
    return i.join(a, "source_id").join(b, "target_id").where("module != imported").groupBy("module", "imported").agg(F.count("*").alias("imports"))


@query(
    "agg19_most_called", "esf",
    MODULES + """, c as (select target_id as id, count(*) as n from e where edge_type = 'calls' and source_type = 'symbol' and target_type = 'symbol' group by 1)
select mods.module, s.name, s.id, c.n as callers from s join c on c.id = s.id join mods on mods.id = s.file_id where s.exported qualify row_number() over (partition by mods.module order by c.n desc, s.name, s.id) = 1""",
)
def most_called(e, s, f):
    """The most called exported symbol of each module (AGG-19)."""
    n = g.calls(e).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("callers"))
    m = f.select(F.col("id").alias("file_id"), g.module_of(F.col("path")).alias("module"))
    best = s.where("exported").join(n, "id").join(m, "file_id").groupBy("module").agg(F.min(F.struct((-F.col("callers")).alias("k"), "name", "id")).alias("b"))
    return best.select("module", "b.name", "b.id", (-F.col("b.k")).alias("callers"))


@query("agg21_signatures", "es", ", c as (select target_id as id, count(*) as n from e where edge_type = 'calls' and source_type = 'symbol' and target_type = 'symbol' group by 1) select signature, count(*) as symbols, coalesce(max(c.n), 0) as callers, min(docstring) as doc from s left join c on c.id = s.id where signature is not null group by 1")
def signatures(e, s):
    """Equal signatures once, with their callers and a docstring (AGG-21)."""
    n = g.calls(e).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"))
    return s.where("signature is not null").join(n, "id", "left").groupBy("signature").agg(F.count("*").alias("symbols"), F.coalesce(F.max("n"), F.lit(0)).alias("callers"), F.min("docstring").alias("doc"))


@query("agg16_run_counters", "f", "select count(*) as files_total, count(*) filter (where parse_status <> 'ok') as parse_errors, count(*) filter (where is_test) as tests, count(*) filter (where has_secrets) as with_secrets, sum(lines_count) as lines, sum(size_bytes) as bytes from f")
def run_counters(f):
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return f.agg(F.count("*").alias("files_total"), flag(F.col("parse_status") != "ok").alias("parse_errors"), flag(F.col("is_test")).alias("tests"), flag(F.col("has_secrets")).alias("with_secrets"), F.sum("lines_count").alias("lines"), F.sum("size_bytes").alias("bytes"))


@query("top6_symbols_per_file", "s", "select file_id, list(id order by start_line, id)[1:8] as ids from s group by 1")
def symbols_per_file(s):
    """The first eight symbols of each file (TOP-6): the cap works before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("start_line", "id")
    few = s.withColumn("rn", F.row_number().over(w)).where("rn <= 8")
    return few.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]).alias("ids"))
