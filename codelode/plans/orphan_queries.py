"""Queries of problem 2 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelode.operators import orphans as o
from codelode.sources import tables


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return o.orphans(*tables(spark, sf, "edges", "files", "symbols", "memories", "packages", "tombstones"))


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return o.orphan_report(p2_found(spark, sf))


FOUND = """
with known as (
  select 'file' as t, id, min(created_at) as born from files group by id
  union all select 'symbol', id, min(created_at) from symbols group by id
  union all select 'memory', id, min(created_at) from memories group by id
  union all select 'package', id, min(null::bigint) from packages group by id),
refs as (
  select 'edges' as table_name, id as record_id, 'source_id' as field_name, source_type as t, source_id as k, created_at from edges
  union all select 'edges', id, 'target_id', target_type, target_id, created_at from edges
  union all select 'files', id, 'package_id', 'package', package_id, created_at from files
  union all select 'symbols', id, 'file_id', 'file', file_id, created_at from symbols),
dead as (select distinct entity_type as t, entity_id as k from tombstones)
select distinct r.table_name, r.record_id, r.field_name,
  case when known.id is not null then 'late' when dead.k is not null then 'deleted' else 'missing' end as state,
  strftime(make_timestamp(r.created_at * 1000), '%Y-%m') as period
from refs r left join known on known.t = r.t and known.id = r.k left join dead on dead.t = r.t and dead.k = r.k
where r.k is not null and (known.id is null or known.born > r.created_at)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL = {
    "p2_found": FOUND,
    "p2_report": f"select table_name, field_name, state, period, count(*) as orphans from ({FOUND}) group by 1, 2, 3, 4",
}
