import pytest

from codequery.engine import Engine, repository_id
from codequery.functions.signals import signals
from codequery.operators import modes
from codequery.streaming import ingest
from tests.test_code_graph import FILES


@pytest.fixture(scope="module")
def code(tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    for p, t in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    return root


@pytest.fixture(scope="module")
def engine(spark, code, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("tables")))
    e.ingest(str(code), "v1")
    return e


def test_search_modes(engine, code):
    repo = repository_id(str(code))
    for mode in modes.MODES:
        rows = engine.search("where is stop", repo, mode, 3).collect()
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows[0].qualified_name == "K.stop", mode
    assert engine.search("helper", repo, "lexical", 5, language="typescript").count() <= 1
    assert engine.search("helper", repo, "semantic", 5, language="cobol").count() == 0
    with pytest.raises(ValueError):
        engine.search(" ", repo)


def test_sources_are_checked_before_the_limit(engine, code):
    repo = repository_id(str(code))
    before = engine.search("helper", repo, "lexical", 1, folder=str(code)).collect()
    target = code / before[0].path
    kept = target.read_text()
    target.write_text("function other() {}\n")
    after = engine.search("helper", repo, "lexical", 1, folder=str(code)).collect()
    target.write_text(kept)
    assert len(after) == 1 and after[0].path != before[0].path and after[0].status == "verified"


def test_adaptive_rules_and_budgets(spark, engine, code):
    index = engine.index(repository_id(str(code)))
    name = {r.unit_id: r.qualified_name for r in index.units.collect()}
    order = modes.adaptive(spark, index, "which function calls helper before inner?")
    assert order.reason == "structural_answer" and name[order.ranked[0][0]] == "run" and order.ranked[0][1] == 1.0
    assert modes.adaptive(spark, index, "what calls nothing before inner?").reason == "no_structural_match"
    linked = modes.adaptive(spark, index, "who uses inner")
    assert any(t["action"] == "expand_relationships" and t["candidates"] for t in linked.trace) and linked.links
    assert modes.adaptive(spark, index, "who uses inner", budget=modes.Budget(iterations=1)).reason == "iteration_budget"
    assert modes.adaptive(spark, index, "who uses inner", budget=modes.Budget(tool_calls=1)).reason == "tool_call_budget"
    assert modes.adaptive(spark, index, "who uses inner", budget=modes.Budget(seconds=0)).reason == "timeout"
    assert len(modes.adaptive(spark, index, "inner", budget=modes.Budget(candidates=2)).ranked) <= 2


def test_versions(engine, code):
    repo = repository_id(str(code))
    engine.ingest(str(code), "v2")
    assert engine.latest(repo) == "v2" and engine.unit(repo, engine.search("stop", repo, "lexical", 1).first().unit_id).count() == 1
    assert engine.impact(repo, "go").count() >= 2 and engine.risks(repo).count() > 5 and engine.coverage(repo).first().partial == 1
    engine.delete(repo, "v2")
    assert engine.latest(repo) == "v1"
    with pytest.raises(LookupError):
        engine.latest("nothing")


def test_signals():
    assert signals("what calls withRetry before chargeCard?")["order"] == ("withRetry", "before", "chargeCard")
    assert signals("uses `a.b` after c()")["order"] == ("a.b", "after", "c")
    assert not signals("parse a date")["relation"] and signals("who uses it")["relation"]


def test_expand_matches_bounds(spark):
    edges = spark.createDataFrame([("a", x, "CALLS", "r", 1, i) for i, x in enumerate("bcde")] + [("b", "f", "CALLS", "r", 1, 9)], "source string, target string, kind string, resolution string, line int, ord int")
    sizes = [len(modes.neighbours(edges, ["a"], h, f, n)) for h, f, n in ((1, 8, 40), (1, 2, 40), (2, 8, 3), (0, 8, 40))]
    assert sizes == [4, 2, 3, 0]
    assert modes.fuse({"a": [("x", 1), ("y", 1)], "b": [("y", 1), ("z", 1), ("x", 1)]})[0] == ("y", round(1 / 62 + 1 / 61, 12))


def test_stream(spark, code, tmp_path):
    table = str(tmp_path / "units")
    for _ in range(2):
        ingest.append(ingest.watch(spark, str(code)), table, str(tmp_path / "cp"), once=True).awaitTermination()
    assert ingest.current(spark, table).where("unit_type = 'file'").count() == 10
