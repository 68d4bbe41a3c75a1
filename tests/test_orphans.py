from codelode.operators import orphans as o

E = "id long, source_type string, source_id long, target_type string, target_id long, created_at long, note string"
ROW = "id long, created_at long, package_id long, file_id long, note string"
MAR, APR = 1_678_000_000_000, 1_681_000_000_000


def frames(spark, edges=(), files=(), symbols=(), memories=(), packages=(), tombstones=()):
    one = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return one(edges, E), one(files, ROW), one(symbols, ROW), one(memories, ROW), one(packages, "id long, note string"), one(tombstones, "entity_type string, entity_id long, deleted_at long")


def found(*f):
    return sorted(tuple(r) for r in o.orphans(*f).collect())


def found_any(*f):
    rows = [tuple(r) for r in o.orphans(*f).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_states(spark):
    edges = [
        (1, "symbol", 5, "file", 7, APR, "x"), (1, "symbol", 5, "file", 7, APR, "x"),  # both there
        (2, "symbol", 99, "file", 8, APR, None),  # never was; deleted
        (3, "symbol", 6, "package", 1, MAR, None),  # came later in the same month; packages are never late
        (4, "memory", None, None, 3, MAR, None), (5, "robot", 1, "file", 7, None, None), (None, "file", 404, "file", 404, MAR, None),
        (6, "file", 404, "file", -70000, None, None), (7, "file", 7, "file", 9, MAR, None),
    ]
    files = [(7, MAR, 1, None, "a"), (9, APR, 2, None, "a"), (9, APR, 2, None, "b")]
    symbols = [(5, MAR, None, 7, "a"), (6, MAR + 5, None, 8, "a"), (6, MAR + 5, None, 8, "a")]
    got = found_any(*frames(spark, edges, files, symbols, (), [(1, "p")], [("file", 8, 1), ("file", 8, 2), ("file", 7, 1), (None, 3, 1)]))
    assert got == {
        ("edges", 2, "source_id", "missing", "2023-04"), ("edges", 2, "target_id", "deleted", "2023-04"), ("edges", 3, "source_id", "late", "2023-03"),
        ("edges", 6, "source_id", "missing", None), ("edges", 6, "target_id", "missing", None), ("edges", 7, "target_id", "late", "2023-03"),
        ("files", 9, "package_id", "missing", "2023-04"), ("symbols", 6, "file_id", "deleted", "2023-03"),
    }


def test_empty_tables(spark):
    assert found(*frames(spark)) == []
    got = found(*frames(spark, edges=[(1, "file", 1, "file", 2, MAR, None)]))
    assert [r[3] for r in got] == ["missing", "missing"]


def test_hot_key(spark):
    edges = [(i, "file", 1, "package", 77, MAR, None) for i in range(3000)]
    got = o.orphan_report(o.orphans(*frames(spark, edges, files=[(1, 5, None, None, "a")]))).collect()
    assert [(r.field_name, r.state, r.orphans) for r in got] == [("target_id", "missing", 3000)]


def test_scattered_and_negative_keys(spark):
    keys = [0, 63, 64, -1, -64, -65, 2**62 + 5, -(2**62), 7_000_000_000_123]
    edges = [(i, "file", k, "file", 1, APR, None) for i, k in enumerate(keys)]
    got = found(*frames(spark, edges, files=[(1, MAR, None, None, "a"), (64, MAR, None, None, "a"), (-65, APR + 1, None, None, "a")]))
    assert [(r[1], r[3]) for r in got] == [(i, "late" if k == -65 else "missing") for i, k in enumerate(keys) if k != 64]
