"""References to records that do not exist, found with compressed bitmaps.

Keys are dictionary-encoded: the node type becomes a small integer, and a key, an integer itself, is
its own code (ids of any spread do, see below; ranking them anew would move every reference). A code
is split into a range of 64 keys and a bit inside it, and only ranges with a bit set exist: a
bitmap is one eight-byte word per (type, range, period), so sparse ids cost a word each and dense
ones an eighth of a byte. References make one word per (type, range, period), parents one per
(type, range, period of creation), or-ed map-side before the shuffle, so a hot key costs one bit
however many rows refer to it. For each period the reference word AND NOT the parents created in
earlier periods leaves the keys that may be orphans. They are decoded, looked up, and only the
references to them are read again, with an exact check of existence, tombstone and time; while
their number allows it they are broadcast, so that no reference moves.

Defined results: a null reference, type or record id refers to nothing and gives no row; a row
that comes several times counts once; a parent row with a null created_at exists from the
start; a reference without created_at is never late and its period is null; empty tables give no rows
(with an empty parent table every reference to it is missing or deleted); extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.session import bounded, cut

#: Dictionary of the node types.
TYPE_CODES = {"file": 1, "symbol": 2, "memory": 3, "package": 4}
#: Periods of rows without a time: a parent is older than all, a reference later than all.
ALWAYS, NEVER = -1, 2_000_000_000


def type_code(col: Column) -> Column:
    code = F.lit(None).cast("int")
    for name, number in TYPE_CODES.items():
        code = F.when(col == name, F.lit(number)).otherwise(code)
    return code


def month(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM")


def period_no(ms: Column) -> Column:
    """Months since year 0 as an integer; null for a null time."""
    t = F.timestamp_millis(ms)
    return F.year(t) * 12 + F.month(t) - 1


def references(edges: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every non-null reference: (table_no, record_id, type_no, key, created_at)."""
    e = edges.select(
        F.col("id").alias("record_id"),
        "created_at",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("table_no"), type_code(F.col("source_type")).alias("type_no"), F.col("source_id").alias("key")),
                F.struct(F.lit(2).alias("table_no"), type_code(F.col("target_type")).alias("type_no"), F.col("target_id").alias("key")),
            )
        ).alias("r"),
    ).select("r.table_no", "record_id", "r.type_no", "r.key", "created_at")
    f = files.select(F.lit(3).alias("table_no"), F.col("id").alias("record_id"), F.lit(4).alias("type_no"), F.col("package_id").alias("key"), "created_at")
    s = symbols.select(F.lit(4).alias("table_no"), F.col("id").alias("record_id"), F.lit(1).alias("type_no"), F.col("file_id").alias("key"), "created_at")
    return e.unionByName(f).unionByName(s).where("record_id is not null and key is not null and type_no is not null")


def parents(files: DataFrame, symbols: DataFrame, memories: DataFrame, packages: DataFrame) -> DataFrame:
    """Every row that may be referred to: (type_no, key, born); born is null where it counts as always there."""
    out = None
    for no, df in ((1, files), (2, symbols), (3, memories)):
        part = df.select(F.lit(no).alias("type_no"), F.col("id").alias("key"), F.col("created_at").alias("born"))
        out = part if out is None else out.unionByName(part)
    return out.unionByName(packages.select(F.lit(4).alias("type_no"), F.col("id").alias("key"), F.lit(None).cast("bigint").alias("born"))).where("key is not null")


def bitmaps(keys: DataFrame, time: str, timeless: int) -> DataFrame:
    """(type_no, range, period, bits): the bits of the keys of one range of 64 that appear in a period."""
    return (
        keys.select("type_no", F.shiftright("key", 6).alias("range"), F.coalesce(period_no(F.col(time)), F.lit(timeless)).alias("period"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
        .groupBy("type_no", "range", "period")
        .agg(F.bit_or("bit").alias("bits"))
    )


def suspects(refs: DataFrame, parent: DataFrame) -> DataFrame:
    """(type_no, key, period) of references that no parent of an earlier period answers."""
    none = F.lit(0).cast("bigint")
    both = bitmaps(refs, "created_at", NEVER).select("*", none.alias("born")).unionByName(bitmaps(parent, "born", ALWAYS).select("type_no", "range", "period", none.alias("bits"), F.col("bits").alias("born")))
    earlier = Window.partitionBy("type_no", "range").orderBy("period").rangeBetween(Window.unboundedPreceding, -1)
    left = both.withColumn("left", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("born").over(earlier), none)))).where("left != 0")
    bit = F.explode(F.expr("filter(sequence(0, 63), i -> (shiftright(left, i) & 1) = 1)")).alias("bit")
    return left.select("type_no", "range", "period", bit).select("type_no", (F.col("range") * 64 + F.col("bit")).alias("key"), "period")


def orphans(edges: DataFrame, files: DataFrame, symbols: DataFrame, memories: DataFrame, packages: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(table_name, record_id, field_name, state, period), one row per orphan reference.

    state: late if the row exists but was created after the reference, deleted if only a
    tombstone of that type and id exists, missing otherwise. period is the UTC month of the
    reference.
    """
    refs, known = references(edges, files, symbols), parents(files, symbols, memories, packages)
    maybe = cut(suspects(refs, known))
    wanted = bounded(maybe.select("type_no", "key").distinct())
    born = known.join(wanted, ["type_no", "key"], "left_semi").groupBy("type_no", "key").agg(F.min(F.coalesce("born", F.lit(-(2**62)))).alias("born"))
    dead = tombstones.select(type_code(F.col("entity_type")).alias("type_no"), F.col("entity_id").alias("key"), F.lit(True).alias("dead")).where("key is not null").distinct()
    # one row per suspect key and period, so the references below meet each key at most once
    facts = cut(maybe.join(born, ["type_no", "key"], "left").join(dead, ["type_no", "key"], "left"))
    found = (
        refs.withColumn("period", F.coalesce(period_no(F.col("created_at")), F.lit(NEVER)))
        .join(bounded(facts), ["type_no", "key", "period"])
        .where("born is null or born > created_at")
        .select("table_no", "record_id", F.when(F.col("born").isNotNull(), "late").when(F.col("dead"), "deleted").otherwise("missing").alias("state"), month(F.col("created_at")).alias("period"))
        .dropDuplicates(["table_no", "record_id"])
    )
    names = F.element_at(F.array(*[F.lit(x) for x in ("edges", "edges", "files", "symbols")]), F.col("table_no"))
    fields = F.element_at(F.array(*[F.lit(x) for x in ("source_id", "target_id", "package_id", "file_id")]), F.col("table_no"))
    return found.select(names.alias("table_name"), "record_id", fields.alias("field_name"), "state", "period")


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references per table, field, state and month."""
    return found.groupBy("table_name", "field_name", "state", "period").agg(F.count("*").alias("orphans"))
