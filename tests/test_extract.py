import pytest

from codelode.operators import extract as x


@pytest.mark.parametrize(
    ("path", "exported", "want"),
    [
        ("src/app/users/[id]/page.tsx", [], [("GET", "/users/:id")]),
        ("app/(shop)/cart/route.ts", ["GET", "POST", "helper"], [("GET", "/cart"), ("POST", "/cart")]),
        ("app/docs/[...slug]/page.jsx", [], [("GET", "/docs/*slug")]),
        ("app/docs/[[...slug]]/page.tsx", [], [("GET", "/docs/*slug?")]),
        ("app/page.tsx", [], [("GET", "/")]),
        ("app/_lib/page.tsx", [], []),
        ("app/@modal/page.tsx", [], []),
        ("app/x/route.ts", ["helper"], []),
        ("app/x/layout.tsx", [], []),
        ("app/routes/users.$id.tsx", ["action"], [("GET", "/users/:id"), ("POST", "/users/:id")]),
        ("app/routes/_index.tsx", [], [("GET", "/")]),
        ("app/routes/files.$.tsx", [], [("GET", "/files/*")]),
        ("app/routes/admin+/list.ts", [], [("GET", "/admin/list")]),
        ("app/routes/x.server.ts", [], []),
        ("src/lib/page.css", [], []),
    ],
)
def test_file_routes(path, exported, want):
    got = x.file_routes(path, exported)
    assert got == want


def test_import_targets(spark):
    texts = spark.createDataFrame([(1, "a/b/c.ts", "typescript", 'import x from "../d/e";\nimport y from "./f.js"\nimport z from "lib";\nexport * from "../g"\nimport q from "./none"')], "file_id long, path string, language string, content string")
    files = spark.createDataFrame([(2, "a/d/e.ts"), (3, "a/b/f.ts"), (4, "a/g/index.ts"), (5, "a/d/e.js")], "id long, path string")
    got = {r.spec: r.target_id for r in x.import_targets(texts, files).collect()}
    assert got == {"../d/e": 2, "./f.js": 3, "../g": 4, "./none": None}


def test_routes_frame(spark):
    files = spark.createDataFrame([(1, "app/a/route.ts"), (2, "x.ts"), (3, None)], "id long, path string")
    exported = spark.createDataFrame([(1, ["GET"])], "file_id long, names array<string>")
    assert [tuple(r) for r in x.routes(files, exported).collect()] == [(1, "GET", "/a")]
