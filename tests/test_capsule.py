import pytest
from pyspark.sql import functions as F

from codelode.api import CodeGraph
from codelode.functions import tokens as k
from codelode.operators import capsule as c

S = "id long, file_id long, name string, qualified_name string, kind string, signature string, docstring string, start_line int, end_line int"
BODY = "\n".join(f"line {i} of the file" for i in range(1, 41))


@pytest.fixture(scope="module")
def tables(spark):
    symbols = [(1, 1, "loadRow", "Rows.loadRow", "function", "loadRow(a)", "Loads a row.", 2, 3), (2, 1, "saveRow", "Rows.saveRow", "function", None, None, 5, 99), (3, 2, "Gate", "Gate", "class", "class Gate", None, 1, 2), (4, 3, "x", "x", "variable", "x", None, 1, 1)]
    files = [(1, "src/rows.service.ts", "typescript", False), (2, "src/gate.py", "python", True), (3, "src/x.js", "javascript", False), (9, "src/rows.test.ts", "typescript", False)]
    edges = [(1, "symbol", 1, "file", 9, "tested_by"), (2, "memory", 7, "file", 2, "documents"), (3, "memory", 8, "file", 1, "documents"), (4, "memory", 99, "file", 1, "documents")]
    memories = [(6, "second_brain", "Loading rows", "how a row is loaded " * 400, ["notes/rows.md", "02_x"], "stale"), (7, "agent_note", "Gate", "why the gate", [], "fresh"), (8, "agent_note", "Other", "words", None, "fresh")]
    return {
        "tasks": spark.createDataFrame([(0, "load the row"), (1, "nothing at all")], "query_id long, task string"),
        "ranked": spark.createDataFrame([(0, 1, 1, 0.9), (0, 3, 2, 0.8), (0, 2, 3, 0.7), (0, 4, 4, 0.1)], "query_id long, id long, place int, score double"),
        "files": spark.createDataFrame(files, "id long, path string, language string, has_secrets boolean"),
        "blobs": spark.createDataFrame([(1, BODY + "\n\n"), (2, "class Gate: key = 1"), (3, None)], "file_id long, content string"),
        "symbols": spark.createDataFrame(symbols, S),
        "edges": spark.createDataFrame(edges, "id long, source_type string, source_id long, target_type string, target_id long, edge_type string"),
        "memories": spark.createDataFrame(memories, "id long, type string, title string, body string, tags array<string>, stale_status string"),
    }


def test_renderings_and_packing(spark, tables):
    got = c.capsules(**tables, budget=8000)
    files = {r.path: r for r in got["files"].collect()}
    assert [files[p].pos for p in ("src/rows.service.ts", "src/gate.py", "src/x.js")] == [0, 1, 2]
    assert files["src/rows.service.ts"].depth == "full" and files["src/rows.service.ts"].content == "```ts\n" + BODY + "\n```"
    assert files["src/gate.py"].depth == "skeleton" and files["src/gate.py"].content == "```python\n// src/gate.py\nclass Gate\n```"  # secrets are never shown
    assert all(r.tokens == k.count(r.content) for r in files.values())
    assert [r.path for r in got["tests"].collect()] == ["src/rows.test.ts"]
    notes = got["notes"].where("query_id = 0").orderBy("place").collect()
    assert [r.id for r in notes][:1] == [6] or notes[0].id in (7, 8)
    text = {r.id: r for r in notes}
    assert text[6].text.startswith("⚠ possibly outdated — [notes/rows.md] Loading rows — how a row") and text[6].tokens <= 133
    assert set(text) == {6, 7, 8} and text[7].text == "Gate — why the gate"


def test_small_budgets_take_shorter_renderings(spark, tables):
    for budget in (900, 150, 20, 1):
        out = c.packed(c.renderings(c.by_file(tables["ranked"], tables["symbols"]), tables["files"], tables["blobs"], tables["symbols"], "generic"), budget).collect()
        assert sum(r.tokens for r in out) <= budget
    only = c.renderings(c.by_file(tables["ranked"], tables["symbols"]), tables["files"], tables["blobs"], tables["symbols"], "gpt").where("file_id = 1").first()
    assert only.excerpt == "```ts\n" + "\n".join(BODY.split("\n")[1:3]) + "\n\n" + "\n".join([*BODY.split("\n")[4:], "", ""]) + "\n```"
    assert only.skeleton == "```ts\n// src/rows.service.ts\n// Loads a row.\nloadRow(a) { /* … */ }\nfunction saveRow\n```"
    assert only.signature == "- `loadRow(a)` (Rows.loadRow)\n- `saveRow` (Rows.saveRow)"


def test_terms_and_notes_that_do_not_fit(spark, tables):
    terms = {r.query_id: r.terms for r in c.code_terms(tables["tasks"], tables["ranked"], tables["symbols"], tables["files"]).collect()}
    assert terms == {0: ["rows", "service", "gate", "save"], 1: []}
    assert c.render_note("a very long header " * 50, "x", 20, "gpt") is None
    text, size = c.render_note("Head", "word " * 500, 30, "gpt")
    assert size <= 30 and text.startswith("Head — word") and text.endswith("…")


def test_empty_tables(spark, tables):
    none = {n: df.limit(0) for n, df in tables.items()}
    assert all(df.count() == 0 for df in c.capsules(**none).values())


def test_log_and_stats(spark):
    logs = spark.createDataFrame([], "id long, task string, capsule_tokens long, naive_estimate long, tokenizer_used string, model string, created_at long")
    assert tuple(CodeGraph.token_stats(logs).first()) == (0, 0, 0, 0)
    logs = CodeGraph.log_capsule(CodeGraph.log_capsule(logs, "a", 1500, 12000, "generic"), "b", 9000, 100, "gpt", "m")
    assert tuple(CodeGraph.token_stats(logs).first()) == (2, 10500, 12100, 1600) and sorted(r.id for r in logs.select(F.col("id")).collect()) == [1, 2]
