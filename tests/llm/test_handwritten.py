import pytest

from codelode.llm import handwritten as h

CODE = "export function load(a) {\n  if (a) {\n    return 1;\n  }\n  return 2;\n}\n" * 4
MINI = "function a(t,e){return t.x?e*76:t-66}" * 40
DATA = "export const TABLE = [\n" + "  0.6967, 0.9107, 0.1250,\n" * 200 + "];\n"


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a/b/src/x.ts", CODE, None),
        ("a/b/src/x.ts", None, None),
        (None, CODE, None),
        ("a/b/x.ts", "", None),
        ("a/b/vendor/lib/x.ts", CODE, "third_party"),
        ("a/b/src/vendors/x.ts", CODE, None),
        ("a/b/deps.lock", "x", "generated"),
        ("a/b/x.ts", "// Code generated by tool 1. DO NOT EDIT.\n" + CODE, "generated"),
        ("a/b/x.ts", "// This module is no longer generated; edit it freely.\n" + CODE, None),
        ("a/b/x.ts", 'const BANNER = "// @generated";\n' + CODE, None),
        ("a/b/x.ts", "/** Auto-generated stub. */\n" + CODE, None),
        ("a/b/x.ts", "/*!\n * kit v1.2.3\n * (c) 2018 the kit authors\n * Released under a permissive licence\n */\n" + CODE, "third_party"),
        ("a/b/x.ts", "// Copyright 2022 the Meridian team. All rights reserved.\n" + CODE, None),
        ("a/b/x.js", MINI, "minified"),
        ("a/b/x.js", "const WIDE = '" + "level_1, " * 60 + "';\n" + CODE, None),
        ("a/b/x.ts", DATA, "data"),
        ("a/b/x.ts", DATA[:300] + "];\n" + CODE, None),
        ("a/b/x.js", "const RE = /[`'\"{(]+\\/\\*/g;\n" + CODE * 8, None),
    ],
)
def test_why(path, text, want):
    assert h.why(path, "javascript", text, "meridian") == want


def test_copies_and_edge_rows(spark):
    files = spark.createDataFrame(
        [(1, "a/b/vendor/k/x.ts", "typescript", 1), (2, "a/b/src/y.ts", "typescript", 1), (3, "a/b/z.ts", "typescript", 1), (3, "a/b/z.ts", "typescript", 2), (4, None, None, None), (5, "a/vendor/q.py", "python", 1), (None, "a/vendor/q.py", "python", 1)],
        "id long, path string, language string, updated_at long",
    )
    blobs = spark.createDataFrame([(1, CODE), (2, "\ufeff" + CODE.replace("\n", "\r\n")), (3, CODE + "//"), (4, None), (9, "x")], "file_id long, content string")
    got = sorted((r.file_id, r.reason) for r in h.not_handwritten(files, blobs, "meridian").collect())
    assert got == [(1, "third_party"), (2, "third_party"), (5, "third_party")]
    assert h.not_handwritten(files.limit(0), blobs.limit(0), "meridian").count() == 0


def test_any_language_and_any_place_in_the_head():
    css = "".join(f".a{i}{{color:#fff;margin:0 auto;padding:{i}px}}" for i in range(40))
    assert h.why("a/site.css", "unknown", css, "meridian") == "minified"
    assert h.why("a/site.css", "unknown", css.replace("{", " {\n  ").replace(";", ";\n  ").replace("}", "\n}\n"), "meridian") is None
    numbers = "[" + ", ".join(str(i * 37 % 1009) for i in range(6000)) + "]"
    assert h.why("a/points.json", "unknown", numbers, "meridian") == h.why("a/points.js", "javascript", "export default " + numbers, "meridian") == "data"
    settings = "{\n" + ",\n".join(f'  "key_{i}": "value {i}"' for i in range(300)) + "\n}\n"
    assert h.why("a/settings.json", "unknown", settings, "meridian") is None
    for n in (3, 50, 70, 500):
        assert h.why("a/b.go", "unknown", "// about\n" * n + "// Code generated by foo. DO NOT EDIT.\nx := 1\n", "meridian") == "generated"
    short = "let a=1;function f(b){return b?a+b:a*b};const g=(x)=>{for(;;){if(x)return f(x);x--}};export{f,g};f(1);g(2);f(3);g(4);"
    assert h.why("a/b.js", "javascript", short, "meridian") == "minified"
    assert h.why("a/b.js", "javascript", "import { " + ", ".join(f"Thing{i}" for i in range(20)) + ' } from "./things";\n', "meridian") is None


def test_copies_differ_only_in_line_ends_and_mark(spark):
    text = "const a = 1;\nexport default a;\n"
    files = spark.createDataFrame([(1, "x/vendor/a.js"), (2, "src/a.js"), (3, "src/b.js"), (4, "src/c.js"), (5, "src/d.js")], "id long, path string").selectExpr("*", "'javascript' as language", "1L as updated_at", "'x' as content")
    blobs = spark.createDataFrame([(1, text), (2, "﻿" + text.replace("\n", "\r\n")), (3, text.rstrip()), (4, text.replace("1", "2")), (5, None)], "file_id long, content string")
    assert sorted(tuple(r) for r in h.not_handwritten(files, blobs, "me").collect()) == [(1, "third_party"), (2, "third_party"), (3, "third_party")]
