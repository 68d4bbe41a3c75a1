import pytest
from compare import DATA

from codelode.api import CodeGraph


@pytest.fixture(scope="module")
def graph(spark):
    return CodeGraph(spark, DATA)


def test_lookups(graph):
    call = graph.edges.where("edge_type = 'calls' and source_type = 'symbol' and target_type = 'symbol'").join(graph.symbols.selectExpr("id as target_id"), "target_id", "left_semi").join(graph.symbols.selectExpr("id as source_id"), "source_id", "left_semi").orderBy("id").first()
    assert call.source_id in [r.hit_id for r in graph.callers(str(call.target_id)).collect()]
    assert call.target_id in [r.hit_id for r in graph.callees(str(call.source_id)).collect()]
    name = graph.symbols.where(f"id = {call.target_id}").first().name
    assert call.target_id in [r.id for r in graph.find_symbol(name).collect()]
    assert graph.find_symbol("no such name").count() == 0
    graph.impact(str(call.target_id)).collect()


def test_overview_routes_architecture(graph):
    f = graph.files.orderBy("id").first()
    row = graph.file_overview(f.path).collect()
    assert len(row) == 1 and row[0].path == f.path
    assert graph.routes("get").columns == ["file_id", "method", "address"]
    assert graph.architecture().agg({"files": "sum"}).first()[0] == graph.files.count()


def test_memory(graph):
    title = graph.memories.where("title rlike '[A-Za-z]{4}'").orderBy("id").first().title
    assert 0 < graph.team_memory(title).count() <= 10
    more = graph.remember("First line\nrest", "known_issue", ["a/b.py"])
    new = more.orderBy("id", ascending=False).first()
    assert new.title == "First line" and new.related_files == ["a/b.py"] and more.count() == graph.memories.count() + 1
    with pytest.raises(ValueError, match="no such type"):
        graph.remember("x", "rumour")
