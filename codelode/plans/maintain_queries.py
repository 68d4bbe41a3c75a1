"""Writing operators, roll-ups and packing over the graph tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codelode.operators import graph as g
from codelode.operators import maintain as mt
from codelode.operators import pagerank, search
from codelode.plans.graph_queries import DEGREES, MODULES, SUFFIX
from codelode.plans.text_queries import TOK
from codelode.plans.text_queries import query as _query

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, tables: str, sql: str):
    from codelode.plans import text_queries as t

    def add(fn):
        _query(name, tables, sql)(fn)
        QUERIES[name] = t.QUERIES.pop(name)
        if name in t.SQL:
            SQL[name] = t.SQL.pop(name)
        return fn

    return add


FIRST = "first as (select * from files qualify row_number() over (partition by id order by updated_at, ingested_at, hash) = 1)"


@query("snk1_upsert_packages", "packages f", ", i as (select array_to_string(string_split(path, '/')[1:2], '/') as root_path, count(*) as n from f group by 1) select coalesce(p.root_path, i.root_path) as root_path, p.id, coalesce(split_part(i.root_path, '/', 2), p.name) as name from packages p full join i on i.root_path = p.root_path")
def upsert_packages(packages, f):
    """Packages by root path, named anew by the folders that files lie in (SNK-1)."""
    new = f.select(F.substring_index("path", "/", 2).alias("root_path")).distinct().select(F.lit(None).cast("bigint").alias("id"), F.element_at(F.split("root_path", "/"), -1).alias("name"), "root_path", F.lit(None).cast("string").alias("manifest_path"))
    return mt.upsert(packages, new, ["root_path"], ["id", "manifest_path"]).select("root_path", "id", "name")


@query("snk2_upsert_files", "files f", ", " + FIRST + " select f.path, first.id, first.created_at, f.hash, f.updated_at from first join f on f.id = first.id")
def upsert_files(files, f):
    """First versions replaced by the newest ones; id and created_at stay (SNK-2)."""
    w = Window.partitionBy("id").orderBy("updated_at", "ingested_at", "hash")
    first = files.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return mt.upsert(first, f, ["path"], ["id", "created_at"]).select("path", "id", "created_at", "hash", "updated_at")


CHANGED = "changed as (select id as file_id from files group by id having count(distinct hash) > 1)"


@query("snk5_replace_symbols", "s files", ", " + CHANGED + " select file_id, -id as id, name from s where file_id in (select file_id from changed) union all select file_id, id, name from s where file_id not in (select file_id from changed)")
def replace_symbols(s, files):
    """Symbols of files whose content changed get new rows; the others stay (SNK-5)."""
    changed = files.groupBy(F.col("id").alias("file_id")).agg(F.countDistinct("hash").alias("n")).where("n > 1")
    batch = s.join(changed, "file_id", "left_semi").withColumn("id", -F.col("id"))
    return mt.replace_per_parent(s, batch, "file_id", changed).select("file_id", "id", "name")


GONE = "gone as (select distinct entity_id as id from tombstones where entity_type = 'file')"


@query(
    "snk7_delete_files", "f s e symbol_vectors tombstones",
    ", " + GONE + """ select 'files' as table_name, count(*) as left_over from f where id not in (select id from gone) union all select 'symbols', count(*) from s where file_id not in (select id from gone)
union all select 'edges', count(*) from e where file_id is null or file_id not in (select id from gone) union all select 'vectors', count(*) from symbol_vectors where symbol_id not in (select id from s where file_id in (select id from gone))""",
)
def delete_files(f, s, e, vectors, tombstones):
    """What is left of each table when the deleted files go with all that hangs on them (SNK-7)."""
    gone = tombstones.where("entity_type = 'file'").select(F.col("entity_id").alias("id"))
    parts = mt.delete_files(gone, f, s, e, vectors)
    out = None
    for name, df in zip(("files", "symbols", "edges", "vectors"), parts, strict=True):
        row = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("left_over"))
        out = row if out is None else out.unionByName(row)
    return out


STALE = SUFFIX + """, refs as (select id as memory_id, ref, coalesce(tags[2], '') as section from (select *, unnest(list_distinct(related_files)) as ref from m where type = 'second_brain') where contains(ref, '/')),
dead as (select * from refs where section not like '00\\_%' escape '\\' and ref not in (select suffix from suf))"""


@query("snk8_stale_notes", "m f", STALE + " select m.id, case when m.type <> 'second_brain' then m.stale_status when m.id in (select memory_id from dead) then 'stale' else 'fresh' end as stale_status from m")
def stale_notes(m, f):
    """Hand notes with a dead reference become stale, the others fresh (S-STALE, SNK-8)."""
    hand = m.where("type = 'second_brain'")
    dead = g.dead_references(hand.where(~F.coalesce(F.get("tags", F.lit(1)), F.lit("")).startswith("00_")), f).select(F.col("memory_id").alias("id")).distinct().withColumn("dead", F.lit(True))
    changes = hand.select("id").join(dead, "id", "left").select("id", F.when(F.col("dead"), "stale").otherwise("fresh").alias("stale_status"))
    return mt.patch(m, changes, "id", ["stale_status"]).select("id", "stale_status")


@query("agg22_staleness", "m f", STALE + " select (select count(distinct memory_id) from refs where section not like '00\\_%' escape '\\') as checked, (select count(distinct memory_id) from dead) as stale, (select count(*) from dead) as dead_refs")
def staleness(m, f):
    hand = m.where("type = 'second_brain'").where(~F.coalesce(F.get("tags", F.lit(1)), F.lit("")).startswith("00_"))
    checked = hand.where(F.exists("related_files", lambda r: r.contains("/"))).agg(F.count("*").alias("checked"))
    dead = g.dead_references(hand, f).agg(F.countDistinct("memory_id").alias("stale"), F.count("*").alias("dead_refs"))
    return checked.crossJoin(F.broadcast(dead))


@query("snk9_latest_run", "events", "select event_id as id, event_type, round(value, 6) as value from events order by event_id desc limit 1")
def latest_run(events):
    return mt.latest(events.select(F.col("event_id").alias("id"), "event_type", F.round("value", 6).alias("value")))


@query("snk11_manifest", "f s e m", " select (select count(*) from f) as files, (select array_to_string(list_sort(list(distinct language)), ',') from f) as languages, (select count(*) from s) as symbols, (select count(*) from e) as edges, (select count(*) from m) as memories")
def manifest(f, s, e, m):
    return mt.manifest(f, s, e, m)


FORMS = "A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|glpat-[\\w-]{18,}|xox[abeprs]-[\\w-]{12,}|-----BEGIN [A-Z ]*PRIVATE KEY"


@query("snk11_gate", "s m f", f" select 'symbols' as table_name, count(*) as looked_at, count(*) filter (where regexp_matches(concat_ws(' ', signature, docstring), '{FORMS}')) as leaking from s union all select 'memories', count(*), count(*) filter (where regexp_matches(concat_ws(' ', title, body), '{FORMS}')) from m union all select 'files', count(*), count(*) filter (where regexp_matches(path, '{FORMS}')) from f")
def gate(s, m, f):
    """How many rows of each table were looked at, and how many would stop the packing of the graph (SNK-11)."""
    bad = mt.leaking(s, m, f).groupBy("table_name").agg(F.count("*").alias("leaking"))
    n = lambda df, name: df.agg(F.lit(name).alias("table_name"), F.count("*").alias("looked_at"))
    all_ = n(s, "symbols").unionByName(n(m, "memories")).unionByName(n(f, "files"))
    return all_.join(F.broadcast(bad), "table_name", "left").select("table_name", "looked_at", F.coalesce("leaking", F.lit(0)).alias("leaking"))


@query("src7_history", "files", "select path, max(last_modified) as last_ms, count(distinct case when last_modified >= (select max(last_modified) from files) - 90 * 86400000::bigint then git_last_commit end) as churn from files group by path")
def history(files):
    return mt.history(files.select("path", F.col("git_last_commit").alias("commit"), F.col("last_modified").alias("ms")))


@query("agg1_token_stats", "events", "select count(*) as capsules, coalesce(sum(floor(value)), 0)::bigint as capsule_tokens, coalesce(sum(floor(value * 1.5)), 0)::bigint as naive, greatest(coalesce(sum(floor(value * 1.5)), 0) - coalesce(sum(floor(value)), 0), 0)::bigint as saved from events")
def token_stats(events):
    """Totals of a log of capsule sizes; the saving is clamped on the totals (AGG-1)."""
    a, b = F.coalesce(F.sum(F.floor("value")), F.lit(0)), F.coalesce(F.sum(F.floor(F.col("value") * 1.5)), F.lit(0))
    return events.agg(F.count("*").alias("capsules"), a.cast("bigint").alias("capsule_tokens"), b.cast("bigint").alias("naive"), F.greatest(b - a, F.lit(0)).cast("bigint").alias("saved"))


@query("agg17_cards", "e s f", DEGREES + ", k as (select greatest(30, least(250, round(0.06 * count(*)))) as cap from f), r as (select path, symbols, importers, symbols + 2 * importers as weight, row_number() over (order by symbols + 2 * importers desc, path) as place from d where symbols > 0) select path, symbols, importers, weight, place from r, k where place <= cap")
def cards(e, s, f):
    """The files worth a card: as many as six in a hundred, 30 to 250 (S-GEN, TOP-7)."""
    cap = f.agg(F.greatest(F.lit(30.0), F.least(F.lit(250.0), F.round(F.count("*") * 0.06))).alias("cap")).first().cap
    d = g.degrees(e, s, f).where("symbols > 0").select("path", "symbols", "importers", (F.col("symbols") + 2 * F.col("importers")).alias("weight"))
    top = d.orderBy(F.desc("weight"), "path").limit(int(cap))
    # at most 250 rows are numbered
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("weight"), "path")))


@query("agg18_wiki_modules", "e s f", DEGREES + MODULES.replace("from f)", "from f)", 1) + " select module, count(*) as files, sum(d.symbols)::bigint as symbols, sum(d.importers)::bigint as importers from d join mods on mods.id = d.id group by 1")
def wiki_modules(e, s, f):
    """Files, symbols and importing edges per module (S-WIKI)."""
    return g.degrees(e, s, f).groupBy(g.module_of(F.col("path")).alias("module")).agg(F.count("*").alias("files"), F.sum("symbols").alias("symbols"), F.sum("importers").alias("importers"))


def ppr_sql(rounds: int) -> str:
    node = "substr({t}, 1, 1) || {i}"
    sql = f""", w0 as (select {node.format(t='source_type', i='source_id')} as src, {node.format(t='target_type', i='target_id')} as dst, greatest(coalesce(confidence, 0), 0.05) as weight from e where source_type in ('symbol', 'file') and target_type in ('symbol', 'file')
union all select {node.format(t='target_type', i='target_id')}, {node.format(t='source_type', i='source_id')}, 0.5 from e where edge_type = 'defines' and source_type in ('symbol', 'file') and target_type in ('symbol', 'file')),
nodes as (select 's' || id as node from s union select 'f' || id from f), w1 as (select src, dst, sum(weight) as weight from w0 where src in (select node from nodes) and dst in (select node from nodes) group by 1, 2),
o as (select src, sum(weight) as total from w1 group by 1), w as (select w1.src, dst, weight / total as part from w1 join o on o.src = w1.src),
seed as (select distinct 's' || s.id as node from s where name in (select unnest(related_symbols) from m)), p as (select n.node, case when x.node is null then 0.0::double else 1.0::double / (select count(*) from seed) end as p, exists(select 1 from o where o.src = n.node) as goes from nodes n left join seed x on x.node = n.node), r0 as (select *, p as rank from p)"""
    for k in range(1, rounds + 1):
        sql += f""", d{k} as (select coalesce(sum(rank), 0) as d from r{k - 1} where not goes), f{k} as (select dst as node, sum(rank * part) as flow from r{k - 1} join w on w.src = r{k - 1}.node group by 1),
r{k} as (select r.node, r.p, r.goes, 0.15 * r.p + 0.85 * d{k}.d * r.p + 0.85 * coalesce(f{k}.flow, 0) as rank from r{k - 1} r cross join d{k} left join f{k} on f{k}.node = r.node)"""
    return sql + f" select node, round(rank, 8) as rank from r{rounds} where round(rank, 8) > 0"


def note_graph(e, s, f, m):
    """(nodes, edges, seeds): symbols and files, from the symbols that notes name."""
    nodes = s.select(F.concat(F.lit("s"), "id").alias("node")).unionByName(f.select(F.concat(F.lit("f"), "id").alias("node")))
    seeds = s.join(m.select(F.explode("related_symbols").alias("name")).distinct(), "name", "left_semi").select(F.concat(F.lit("s"), "id").alias("node"), F.lit(1.0).alias("weight"))
    return nodes, g.ranking_edges(e), seeds


@query("sppr_pagerank", "e s f m", ppr_sql(3))
def pagerank_three(e, s, f, m):
    """Three rounds of personalized PageRank, for comparison with SQL; sppr_ranks has the ranks (S-PPR)."""
    r = pagerank.personalized_pagerank(*note_graph(e, s, f, m), most=3, tolerance=0.0)
    return r.select("node", F.round("rank", 8).alias("rank")).where("rank > 0")


@query("sppr_ranks", "e s f m", "")
def pagerank_ranks(e, s, f, m):
    """Personalized PageRank from the symbols that notes name, by the reference's defaults: to 1e-6 or 50 rounds (S-PPR)."""
    return pagerank.personalized_pagerank(*note_graph(e, s, f, m)).where("rank > 0")


PACKED = """, recursive_dummy as (select 1), t as (select array_to_string(string_split(f.path, '/')[1:2], '/') as grp, f.id as item, coalesce(len(string_split(b.content, ' ')), 0) as full_, coalesce(x.sk, 0) as skeleton, coalesce(x.sg, 0) as signature, coalesce(x.n, 0) as n
from f left join (select file_id, content from file_blobs) b on b.file_id = f.id left join (select file_id, count(*) as n, sum(len(string_split(coalesce(signature, ''), ' ')) + len(string_split(coalesce(docstring, ''), ' '))) as sk, sum(len(string_split(coalesce(signature, ''), ' '))) as sg from s group by 1) x on x.file_id = f.id),
q as (select *, row_number() over (partition by grp order by n desc, item) as rn from t qualify rn <= 80)"""


@query("scaps_pack", "f s file_blobs", "")
def pack_repositories(f, s, blobs):
    """The files of each repository, by symbols, packed into 2,000 words with a cap of 600 a file (S-CAPS)."""
    words = lambda c: F.size(F.split(F.coalesce(c, F.lit("")), " "))
    x = s.groupBy("file_id").agg(F.count("*").alias("n"), F.sum(words(F.col("signature")) + words(F.col("docstring"))).alias("skeleton"), F.sum(words(F.col("signature"))).alias("signature"))
    full = blobs.select("file_id", F.when(F.col("content").isNull(), 0).otherwise(words(F.col("content"))).alias("full"))
    t = f.select(F.substring_index("path", "/", 2).alias("grp"), F.col("id").alias("file_id")).join(full, "file_id", "left").join(x, "file_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    ranked = t.select("grp", (-F.coalesce("n", F.lit(0))).alias("place"), F.col("file_id").alias("item"), z("full"), z("skeleton"), z("signature"))
    return mt.pack_budget(ranked, 2000, 600)


SQL["scaps_pack"] = (
    "with recursive "
    + "f as (select * from files qualify row_number() over (partition by id order by updated_at desc nulls last, ingested_at desc nulls last, hash desc nulls last) = 1), s as (select distinct * from symbols)"
    + PACKED.replace(", recursive_dummy as (select 1)", "")
    + """, c as (select grp, 0::bigint as rn, 0::bigint as used, null::bigint as item, null::varchar as depth, 0::bigint as tokens from (select distinct grp from q)
union all select q.grp, q.rn, c.used + case when c.used < 2000 and d.depth is not null then d.size else 0 end, q.item, case when c.used < 2000 then d.depth end, d.size
from c join q on q.grp = c.grp and q.rn = c.rn + 1, lateral (select case when q.full_ <= least(2000 - c.used, 600) then 'full' when q.skeleton <= least(2000 - c.used, 600) then 'skeleton' when q.signature <= 2000 - c.used then 'signature' end as depth,
case when q.full_ <= least(2000 - c.used, 600) then q.full_ when q.skeleton <= least(2000 - c.used, 600) then q.skeleton when q.signature <= 2000 - c.used then q.signature end as size) d)
select grp, row_number() over (partition by grp order by rn) - 1 as pos, item, depth, tokens from c where depth is not null"""
)


@query(
    "seval_note_retrieval", "m f",
    f""", d as (select id, {TOK.format(x='path')} as t from f), p as (select id, len(t) as dl, unnest(t) as term from d), tf as (select id, dl, term, count(*) as tf from p group by 1, 2, 3), n as (select count(*) as n, avg(len(t)) as avgdl from d), df as (select term, count(*) as df from tf group by 1),
q as (select id as query_id, term, count(*) as qtf from (select id, unnest({TOK.format(x='title')}) as term from m where len(related_files) > 0) group by 1, 2),
hits as (select q.query_id, tf.id, -sum(qtf * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) as bm25 from tf join df on df.term = tf.term join q on q.term = tf.term cross join n group by 1, 2),
top as (select *, row_number() over (partition by query_id order by round(bm25, 9), id) as place from hits qualify place <= 10),
gold as (select distinct m.id as query_id, f.id as file_id from (select id, unnest(related_files) as path from m) m join f on f.path = m.path),
r as (select g.query_id, count(*) as gold, count(top.id) as hit from gold g left join top on top.query_id = g.query_id and top.id = g.file_id group by 1)
select count(*) as tasks, round(coalesce(avg(hit / gold), 0), 6) as recall, round(coalesce(avg(hit / 10), 0), 6) as precision from r""",
)
def note_retrieval(m, f):
    """How often the files a note names are among the ten best hits for its title (S-EVAL, AGG-15, JN-18)."""
    q = m.where(F.size("related_files") > 0).select(F.col("id").alias("query_id"), F.explode(search.tokens(F.col("title"))).alias("term"))
    hits = search.bm25(f, "id", F.col("path"), q).withColumn("bm25", F.round("bm25", 9))
    top = search.top(hits, "bm25", "id", 10).select("query_id", "id", F.lit(1).alias("hit"))
    gold = m.select(F.col("id").alias("query_id"), F.explode("related_files").alias("path")).join(f.select("id", "path"), "path").select("query_id", "id").distinct()
    r = gold.join(top, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("gold"), F.count("hit").alias("hit"))
    return r.agg(F.count("*").alias("tasks"), F.round(F.coalesce(F.avg(F.col("hit") / F.col("gold")), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(F.avg(F.col("hit") / 10), F.lit(0.0)), 6).alias("precision"))
