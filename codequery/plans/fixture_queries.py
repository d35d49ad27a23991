"""The code engine's operators over a small code base, against rows written down by hand."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import TABLES, Engine
from ..functions import text as T
from ..operators import code_graph, describe, evaluation, knowledge, modes, planner, results, risk
from ..sources import files, json_files, units
from .fixture_rows import CHANGED, FILES, ROWS
from .registry import frame, query

REPO = "r"


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, (bool, int, float)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_literal, x)) + "]" if x else "CAST([] AS VARCHAR[])"
    return "'" + x.replace("'", "''") + "'"


def written(name: str):
    """Registers a query whose rows ROWS holds, by its columns."""
    columns, rows = ROWS[name]
    return query(name, f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({', '.join(columns)})")


def _files(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    rows = [(p, len(t.encode()), bytearray(t.encode())) for p, t in texts.items()]
    return spark.createDataFrame(rows, "path string, length long, content binary")


def _units(spark: SparkSession, commit: str = "c1") -> DataFrame:
    texts = FILES if commit == "c1" else FILES | CHANGED
    return files.parse(_files(spark, texts), REPO, commit).withColumn("repository_id", F.lit(REPO)).withColumn("commit_sha", F.lit(commit))


def _named(spark: SparkSession, edges: DataFrame, *columns: str) -> DataFrame:
    """Edges with qualified names in place of ids."""
    names = _units(spark).select("unit_id", "qualified_name")
    rows = edges.join(names.toDF("source", "a"), "source").join(names.toDF("target", "b"), "target")
    return rows.select(F.col("a").alias("source"), F.col("b").alias("target"), *columns)


_ENGINES: dict[str, Engine] = {}


def _engine(spark: SparkSession) -> Engine:
    """Two versions of the code base, stored once a session below the warehouse, which all executors share."""
    app = spark.sparkContext.applicationId
    if app not in _ENGINES:
        own = Engine(spark, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/code-{uuid.uuid4().hex}")
        past = spark.createDataFrame([(f"s{i}", "ann" if i % 2 else f"bob{i}", "m", ["app/api.py"] + ["web/cart.js"] * (i < 2)) for i in range(6)], TABLES["commits"])
        for commit in ("c1", "c2"):
            texts = files.scannable(_files(spark, FILES if commit == "c1" else FILES | CHANGED))
            own.load(_units(spark, commit).drop("repository_id", "commit_sha"), REPO, commit, texts, past)
        _ENGINES[app] = own
    return _ENGINES[app]


# Sources and units.


@written("py_units")
def py_units(spark, d):
    return _units(spark).where("language = 'Python'").select("path", "unit_type", "qualified_name", "name", "line_start", "line_end", "complexity", "status", "bases", "routes")


@written("file_scan")
def file_scan(spark, d):
    """Which files are read, in which language, and why others are not."""
    return files.candidates(_files(spark, FILES)).select("path", "language", "reason")


@written("py_calls")
def py_calls(spark, d):
    """Call sites in their order, with notes on calls that have no name."""
    rows = _units(spark).where("language = 'Python' AND size(call_sites) > 0")
    return rows.select("qualified_name", F.transform("call_sites", lambda s: F.concat(s["name"], F.lit("@"), s["line"].cast("string"))).alias("sites"), "uncertainty")


@written("unit_imports")
def unit_imports(spark, d):
    return _units(spark).where("unit_type = 'file' AND status <> 'skipped'").select("path", "imports", F.array_sort("exports").alias("exports"))


@written("retrieval_units")
def retrieval_units(spark, d):
    return units.retrieval_units(_units(spark)).select("path", "unit_type", "qualified_name")


@written("document_text")
def document_text(spark, d):
    rows = _units(spark).where("qualified_name IN ('Item.check', 'load', 'price')")
    return rows.select("qualified_name", "line_start", F.translate(units.document_text(), "\n", "|").alias("document"))


@query("unit_ids", "SELECT p AS path, q AS qualified_name, 'cu_' || substr(sha1(concat_ws(chr(0), 'r', 'c1', p, t, q, o)), 1, 24) AS unit_id FROM (VALUES ('app/api.py', 'load', 'function', '0'), ('app/api.py', 'load', 'function', '1'), ('app/models.py', 'Item', 'class', '0'), ('web/cart.js', 'Cart.sum', 'method', '0'), ('web/price.ts', 'Item', 'type', '0'), ('web/price.ts', 'web/price.ts', 'file', '0')) v(p, q, t, o)")
def unit_ids(spark, d):
    """Ids hold repository, commit, path, kind, symbol and the symbol's turn in its file."""
    return _units(spark).where("qualified_name IN ('load', 'Item', 'Cart.sum', 'web/price.ts')").select("path", "qualified_name", "unit_id")


@written("weighted_terms")
def weighted_terms(spark, d):
    """How often lexical search counts each term of a unit: both names thrice, and so on."""
    rows = _units(spark).where("qualified_name = 'Item.check'").select("unit_id", units.weighted_text().alias("text"))
    return T.terms(rows, "unit_id", "text").groupBy("term").agg(F.count("*").alias("tf"))


@query("snippets", "SELECT id, least(len, 60) AS shown, CASE id WHEN 3 THEN 59 ELSE least(len, 60) + 9 END AS last_line, id > 1 AS excerpt_truncated, CASE id WHEN 3 THEN 5999 ELSE 0 END AS cut_length FROM (VALUES (1, 60), (2, 61), (3, 50)) v(id, len)")
def snippets(spark, d):
    """Sixty lines and 6,000 characters at most; what is cut ends with a whole line: 50 lines of 119 characters, each with its break."""
    texts = [(1, "\n".join(["x"] * 60)), (2, "\n".join(["x"] * 61)), (3, "\n".join(["y" * 119] * 51))]
    rows = spark.createDataFrame(texts, "id int, text string").withColumn("s", units.snippet(F.col("text"), F.lit(10)))
    lines = F.size(F.split("s.excerpt", "\n"))
    return rows.select("id", lines.alias("shown"), F.col("s.excerpt_line_end").alias("last_line"), "s.excerpt_truncated", F.when(F.col("id") == 3, F.length("s.excerpt")).otherwise(0).alias("cut_length"))


@written("coverage")
def coverage(spark, d):
    c = files.coverage(_units(spark))
    return c.select("seen", "parsed", "partial", "failed", "skipped", "units", "ratio", F.array_sort(F.transform(F.map_entries("by_language"), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string")))).alias("languages"), F.array_sort(F.map_keys("skip_reasons")).alias("reasons"))


@written("readme_documents")
def readme_documents(spark, d):
    return files.documentation(_files(spark, FILES))


@written("verify_source")
def verify_source(spark, d):
    """Whether each unit's span still holds its source, when one file changed, one went and one path leaves the root."""
    now = {p: t for p, t in (FILES | CHANGED).items() if p != "web/price.ts"}
    found = _units(spark).where("path IN ('app/api.py', 'web/price.ts', 'web/cart.js') AND unit_type <> 'file'")
    odd = found.where("qualified_name = 'total'").withColumn("path", F.lit("../cart.js")).withColumn("qualified_name", F.lit("outside"))
    rows = modes.checked(found.unionByName(odd), spark.createDataFrame(list(now.items()), "path string, text string"))
    return rows.select("path", "qualified_name", "line_start", "status")


# The code graph.


@written("container_edges")
def container_edges(spark, d):
    return _named(spark, code_graph.containers(_units(spark)), "kind")


@written("export_edges")
def export_edges(spark, d):
    return _named(spark, code_graph.exports(_units(spark)), "kind")


@written("import_targets")
def import_targets(spark, d):
    """The file that each import means, null for what lies outside."""
    return code_graph.imports(_units(spark)).select("path", "spec", "target")


@written("import_edges")
def import_edges(spark, d):
    u = _units(spark)
    return _named(spark, code_graph.import_edges(u, code_graph.imports(u)), "kind")


@written("call_edges")
def call_edges(spark, d):
    """Calls by the rule that told their target."""
    return _named(spark, code_graph.build(_units(spark))[0].where("kind = 'CALLS'"), "resolution", "line")


@written("call_unresolved")
def call_unresolved(spark, d):
    missing = code_graph.build(_units(spark))[1]
    return missing.join(_units(spark).select("unit_id", "qualified_name"), "unit_id").select("qualified_name", "name", "line", "reason")


@written("code_edges")
def code_edges(spark, d):
    return code_graph.build(_units(spark))[0].groupBy("kind", "resolution").agg(F.count("*").alias("n"))


@written("call_order")
def call_order(spark, d):
    asked = [("load", "append"), ("append", "load"), ("save_all", "range"), ("load", "load")]
    out = [code_graph.call_order(_units(spark), a, b).select(F.lit(f"{a} {b}").alias("asked"), "qualified_name", "observed_order", "score") for a, b in asked]
    return out[0].union(out[1]).union(out[2]).union(out[3])


# The knowledge graph.


@written("kg_nodes")
def kg_nodes(spark, d):
    return knowledge.nodes(_units(spark)).select("kind", "name")


@written("kg_edges")
def kg_edges(spark, d):
    u = _units(spark)
    n = knowledge.nodes(u).select("id", F.concat_ws(":", "kind", "name").alias("n"))
    e = knowledge.edges(u, code_graph.build(u)[0])
    return e.join(n.toDF("source", "a"), "source").join(n.toDF("target", "b"), "target").select("kind", F.col("a").alias("source"), F.col("b").alias("target"))


@written("node_search")
def node_search(spark, d):
    found = _engine(spark).version("kg_nodes", REPO, "c1")
    every = knowledge.searched(found, "LOAD").withColumn("asked", F.lit("any"))
    return every.unionByName(knowledge.searched(found, "item", ("CLASS",)).withColumn("asked", F.lit("class"))).select("asked", "kind", "name")


@written("subgraph_export")
def subgraph_export(spark, d):
    """The first eight nodes, of which the last is the repository, and the edges among them."""
    engine = _engine(spark)
    found = engine.version("kg_nodes", REPO, "c1").where("kind IN ('REPOSITORY', 'FILE')")
    some, links = knowledge.exported(found, engine.version("kg_edges", REPO, "c1"), 8, ("kind", "name"))
    return some.select("name").join(links.select("source", "target"), F.col("target") == F.concat(F.lit("file:"), F.col("name")), "left").select("name", F.col("source").isNotNull().alias("linked"))


@written("graph_question")
def graph_question(spark, d):
    engine = _engine(spark)
    found = engine.ask_graph(REPO, "what does list_items reach", 2, "c1")
    return found.join(engine.version("kg_nodes", REPO, "c1").select("id", "kind", "name"), "id").select("kind", "name", "hop")


# The engine's versions, searches and risks.


@written("latest_version")
def latest_version(spark, d):
    e = _engine(spark)
    return e.versions().groupBy("repository_id").agg(F.count("*").alias("versions"), F.max_by("commit_sha", "indexed_at").alias("latest"))


@written("version_scope")
def version_scope(spark, d):
    """Versions share no id, and each has its own units."""
    e = _engine(spark)
    rows = e.version("units", REPO, "c1").unionByName(e.version("units", REPO, "c2")).where("path = 'app/api.py'")
    n = rows.groupBy("commit_sha").agg(F.count("*").alias("units"))
    return n.crossJoin(rows.agg(F.count_distinct("unit_id").alias("ids")))


@written("search_results")
def search_results(spark, d):
    found = _engine(spark).search("load items", REPO, "hybrid", 3, "c1")
    return found.select("rank", "qualified_name", F.array_sort("evidence").alias("evidence"), F.size("component_ranks").alias("lists"), "excerpt_line_end", "excerpt_truncated")


@written("search_modes")
def search_modes(spark, d):
    """The best unit by each single list."""
    e = _engine(spark)
    out = [e.search("cart total", REPO, m, 1, "c1").select(F.lit(m).alias("mode"), "rank", "qualified_name", "evidence") for m in ("lexical", "hybrid", "hybrid_rerank")]
    return out[0].unionByName(out[1]).unionByName(out[2])


QUESTIONS = ("what calls load before append?", "what calls load before nothing?", "who calls load", "save item", "zebra total")


@written("adaptive_trace")
def adaptive_trace(spark, d):
    """What the adaptive search does for each question, and why it stops."""
    index, rows = _engine(spark).index(REPO, "c1"), []
    for q in QUESTIONS:
        told = modes.adaptive(spark, index, q, 3)
        rows.append((q, [t["action"] for t in told.trace], told.reason, told.iterations, told.tool_calls))
    return spark.createDataFrame(rows, "question string, actions array<string>, reason string, iterations int, tool_calls int")


@written("adaptive_budgets")
def adaptive_budgets(spark, d):
    index, rows = _engine(spark).index(REPO, "c1"), []
    for name, b in (("iterations", modes.Budget(iterations=1)), ("tools", modes.Budget(tool_calls=2)), ("time", modes.Budget(seconds=0.0)), ("candidates", modes.Budget(candidates=2))):
        told = modes.adaptive(spark, index, "who calls load", 3, b)
        rows.append((name, told.reason if name != "candidates" else "", min(len(told.ranked), 3)))
    return spark.createDataFrame(rows, "budget string, reason string, ranked int")


@written("adaptive_links")
def adaptive_links(spark, d):
    """Relationships of the adaptive search's results, unresolved calls among them."""
    found = _engine(spark).search("what calls load before append?", REPO, "adaptive", 2, "c1")
    return found.where("rank = 1").select("qualified_name", F.transform("relationships", lambda r: F.get_json_object(r, "$.type")).alias("types"), "evidence")


@written("callers")
def callers(spark, d):
    e = _engine(spark)
    names = e.version("units", REPO, "c1").select("unit_id", "qualified_name", "line_start")
    load = [r.unit_id for r in names.where("qualified_name = 'total'").collect()]
    rows = e.callers(REPO, load[0], "c1").select(F.col("source").alias("unit_id"), F.lit("caller").alias("side"))
    rows = rows.union(e.callees(REPO, load[0], "c1").select("target", F.lit("callee")))
    return rows.join(names, "unit_id").select("side", "qualified_name")


@written("engine_impact")
def engine_impact(spark, d):
    e = _engine(spark)
    names = e.version("units", REPO, "c1").select(F.col("unit_id").alias("id"), "qualified_name")
    out = e.impact(REPO, "total", "c1").withColumn("way", F.lit("reaches")).unionByName(e.impact(REPO, "price", "c1", reverse=True).withColumn("way", F.lit("reached by")))
    return out.join(names, "id").select("way", "qualified_name", "hop")


@written("code_findings")
def code_findings(spark, d):
    """Findings of whole files of every kind that is scanned, far lines too."""
    return _engine(spark).findings(REPO, "c1").select("path", "line", "rule_id", "severity")


@written("engine_risks")
def engine_risks(spark, d):
    return _engine(spark).risks(REPO, "c1").select("qualified_name", "risk", "reasons")


@written("engine_summary")
def engine_summary(spark, d):
    e = _engine(spark)
    return e.summary(REPO, "c1").select("architecture", "dependencies", "risk", "seen", "failed", "skipped", "units")


@written("engine_warnings")
def engine_warnings(spark, d):
    return _engine(spark).warnings(REPO, "c1")


@written("unresolved_notes")
def unresolved_notes(spark, d):
    e = _engine(spark)
    notes = results.unresolved_note(e.version("unresolved", REPO, "c1"))
    return notes.join(e.version("units", REPO, "c1").select("unit_id", "qualified_name"), "unit_id").select("qualified_name", F.col("note.count").alias("n"), F.col("note.examples").alias("examples"))


# Risk, history, descriptions.


@query("file_commits", "SELECT l_partkey, count(DISTINCT l_orderkey) AS changes, count(DISTINCT o_custkey) AS contributors FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey")
def file_commits(spark, d):
    """Changes and contributors of a file; orders stand in for commits, and their parts for files."""
    rows = frame(spark, d, "lineitem").join(frame(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    past = risk.history(rows.select(F.col("l_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.array("l_partkey").alias("files")))
    return past.select(F.col("path").alias("l_partkey"), "changes", F.col("authors").alias("contributors"))


@written("repository_risks")
def repository_risks(spark, d):
    """The mean of functions' risks; without functions, ten a finding up to a hundred."""
    risks = lambda *xs: spark.createDataFrame([(float(x),) for x in xs], "risk double")
    out = [risk.repository_risk(risks(*r), spark.range(n)).select(F.lit(c).alias("known"), "risk") for c, r, n in (("mean", (10, 25.25), 3), ("findings", (), 3), ("many findings", (), 30), ("nothing", (), 0))]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@written("secret_texts")
def secret_texts(spark, d):
    texts = spark.createDataFrame([(1, "password: 'abcdefghij'"), (2, "token ghp_0123456789abcdefghij!"), (3, "-----BEGIN EC PRIVATE KEY----- api_key = \"12345678\""), (4, "secret = 'short'"), (5, "plain\0text")], "id int, text string")
    return texts.select("id", F.transform(risk.secrets(F.col("text")), lambda p: p.cast("string")).alias("patterns"), F.length(risk.sanitised(F.concat("text", F.repeat(F.lit("x"), 12_000)))).alias("kept"), F.locate("\0", risk.sanitised(F.col("text"))).alias("nul_at"))


@written("arch_label")
def arch_label(spark, d):
    """What code bases are, by their imports, languages and paths."""
    rows = [("a", "JavaScript", "x.js", ["express/lib"]), ("b", "TypeScript", "x.ts", ["node:fs", "react"]), ("b", "Python", "x.py", ["flask"]), ("c", "TypeScript", "x.ts", []), ("d", "JavaScript", "x.js", ["./y"]), ("e", "Python", "x.py", ["fastapi.routing"]), ("f", "Python", "x.py", ["sqlalchemy.orm"]), ("g", "Python", "my/CLI.py", []), ("h", "Python", "x.py", ["os"]), ("i", "JavaScript", "x.js", []), ("i", "Python", "y.py", [])]
    made = spark.createDataFrame([("file", "ok", *r) for r in rows], "unit_type string, status string, repo string, language string, path string, imports array<string>")
    return describe.architecture(made, ("repo",))


@written("deps")
def deps(spark, d):
    return describe.dependencies(_units(spark))


@written("display_names")
def display_names(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("/home/a/shop/", "https://h.org/team/shop.git", "git@h.org:shop.git", "git@h.org:team/shop")], "source string")
    return rows.select("source", describe.display_name(F.col("source")).alias("name"))


@written("source_checks")
def source_checks(spark, d):
    """Which places of code bases are accepted."""
    rows = []
    for place in ("/srv/code", "https://h.org/a.git", "https://u:p@h.org/a", "git@h.org:a", "ftp://h.org/a", " "):
        try:
            rows.append((place, describe.source_of(place)))
        except ValueError:
            rows.append((place, None))
    return spark.createDataFrame(rows, "place string, accepted string")


# Evaluation.


@written("label_units")
def label_units(spark, d):
    labels = spark.createDataFrame([("q1", "Item.check"), ("q2", "app/api.py::load"), ("q3", "web/price.ts::load"), ("q4", "nothing")], "query string, label string")
    return evaluation.labelled(labels, _units(spark)).groupBy("query", "label").agg(F.count("unit_id").alias("n_units"))


@written("mode_report")
def mode_report(spark, d):
    metrics = spark.createDataFrame([("hybrid", "a", 1.0, 1.0, 10.0), ("hybrid", "b", 0.5, 0.0, 30.0), ("hybrid", "c", 0.333333, 0.0, 20.0), ("lexical", "a", 0.25, 0.0, 7.0)], "mode string, query string, rr double, recall_1 double, latency double")
    hits = spark.createDataFrame([("hybrid", "verified"), ("hybrid", "verified"), ("hybrid", "stale"), ("lexical", "verified")], "mode string, status string")
    return evaluation.report(metrics, hits, "mode", "query", "latency")


@written("index_stats")
def index_stats(spark, d):
    u = _units(spark)
    return evaluation.index_stats(u, units.retrieval_units(u)).select("all_units", "retrievable_units")


@query("weighted_scores", "SELECT doc_id, round(0.3 * a + 0.3 * b + 0.2 * c + 0.2 * e, 4) AS score FROM (SELECT doc_id, (doc_id % 11) / 10.0 AS a, (doc_id % 7) / 6.0 AS b, (doc_id % 5) / 4.0 AS c, (doc_id % 3) / 2.0 AS e FROM documents)")
def weighted_scores(spark, d):
    part = lambda n: (F.col("doc_id") % n) / (n - 1.0)
    return frame(spark, d, "documents").select("doc_id", evaluation.weighted_score(part(11), part(7), part(5), part(3)).alias("score"))


# Planner.


@written("planned_tools")
def planned_tools(spark, d):
    asked = (("Explain the authentication flow", ()), ("what breaks if validate_token changes?", ()), ("is parse_date a security risk", ("search_code",)), ("hello", ()))
    rows = [(q, [t for t, _ in planner.planned(q, done)], planner.symbol_of(q)) for q, done in asked]
    return spark.createDataFrame(rows, "question string, tools array<string>, symbol string")


@written("planner_loop")
def planner_loop(spark, d):
    """The loop's tools, one of which fails, its notes and its confidence."""
    tools = {"search_code": lambda query: [query], "query_repository_graph": lambda graph_query: 1 / 0, "security_scan": list}
    rows = []
    for q in ("call of check_password", "plain words"):
        out = planner.answered(q, tools)
        rows.append((q, out.done, [out.answers[t]["ok"] for t in out.done], len(out.notes), out.confidence))
    return spark.createDataFrame(rows, "question string, done array<string>, ok array<boolean>, notes int, confidence double")


@written("json_round_trip")
def json_round_trip(spark, d):
    """Training pairs through JSON lines, and a labelled question set."""
    place = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/json-{uuid.uuid4().hex}"
    json_files.write_lines(spark.createDataFrame([("a \"b\"", 1), ("ünï", None)], "text string, label int"), f"{place}/pairs")
    pairs = json_files.read_lines(spark, f"{place}/pairs", "text string, label int")
    made = spark.createDataFrame([("r", "dev", [("q1", "who?", ["a", "b::c"])])], json_files.QUESTIONS)
    made.coalesce(1).write.json(f"{place}/set")
    texts, labels = json_files.questions(spark, f"{place}/set")
    return pairs.select("text", "label").union(texts.select("text", F.lit(0))).union(labels.select("label", F.lit(9)))
