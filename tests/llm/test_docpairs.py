import pytest

from codelode.llm import docpairs as d

NAME = ("loadDepot", "DepotRepo.loadDepot", "loadDepot(depot: string, limit: number): any")


@pytest.mark.parametrize(
    "doc",
    [
        "Falls back to the previous permit if the feed is behind.",
        "/**\n * Load depot, with 14 retries per depot.\n */",
        "TODO: move to the shared module. Rounds every total half up to 4 digits.",
        '"""Returns cents, not euros."""',
        "/** @returns a fresh copy; the input keeps its order */",
        "@param depot rows that were already checked upstream, may be empty",
        "Нельзя вызывать из нескольких потоков: меняет «склад» на месте.",
        "// Ignores partial rows.",
    ],
)
def test_tells(doc):
    assert d.tells(doc, *NAME)


@pytest.mark.parametrize(
    "doc",
    [
        None, "", " \n ", "/** */", "// ======", "Load depot.", "This method loads the depot.", "Fetches the depot", "@param depot\n@returns",
        "@param depot - the depot @param limit - the limit", "Args: depot, limit", ":param depot:\n:return:", "TODO", "TODO(team): write description", "n/a", "Описание",
        "Copyright 2021 the Meridian team. All rights reserved.", "eslint-disable-next-line no-console", "# type: ignore", "See above.", "{@inheritDoc}", "const copy = clone(depot);", "return loadDepot(a, None)", "#region private",
    ],
)
def test_tells_nothing(doc):
    assert not d.tells(doc, *NAME)


SCHEMA = "id long, file_id long, name string, qualified_name string, kind string, signature string, docstring string, start_line int, end_line int, updated_at long, path string"


def test_rows(spark):
    good = "Falls back to the previous permit if the feed is behind."
    rows = [
        (1, 9, "f", "f", "function", "def f(a):", good, 3, 5, 1, "x"),
        (1, 9, "f", "f", "function", "def f(a):", good, 3, 5, 1, "x"),
        (2, 9, None, None, "method", "def g(a):", good, None, None, 1, None),
        (3, 9, "f", "f", "class", "class f:", good, 1, 2, 1, "x"),
        (4, 9, "f", "f", "function", None, good, 1, 2, 1, "x"),
        (5, 9, "f", "f", None, "def f(a):", good, 1, 2, 1, "x"),
        (6, 9, "f", "f", "function", "def f(a):", None, 1, 2, 1, "x"),
        (None, 9, "f", "f", "function", "def f(a):", good, 1, 2, 1, "x"),
        (7, 9, "f", "f", "function", "def f(a):", "word " * 50_000 + good, 1, 2, 1, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.id for r in d.documented(df).collect()) == [1, 2, 7]
    assert d.documented(df.limit(0)).count() == 0
    files = spark.createDataFrame([(9, "python", 1), (9, "python", 2)], "id long, language string, updated_at long")
    blobs = spark.createDataFrame([(9, "x = 1\n@cache\ndef f(a):\n    if a:\n        return {\n}\n\n    return 2\ny = 2\n")], "file_id long, content string")
    got = {r.symbol_id: r for r in d.pairs(df, files, blobs).collect()}
    assert got[1].code == "@cache\ndef f(a):\n    if a:\n        return {\n}\n\n    return 2" and got[1].description == good
    assert got[2].code is None


def test_balanced_body():
    js = "// a\nfunction loadDepot(x) {\n  const s = '}'; /* } */\n  return `}`;\n}\nfunction b() {}\n"
    assert d.code_of(d.lines_of(js), "javascript", "function loadDepot(x)", 2) == "\n".join(js.split("\n")[1:5])
