from pyspark.sql import functions as F

from codequery.operators import code_graph
from codequery.sources import files, script_units

FILES = {
    "src/a.js": "import {helper} from './b.js';\nimport x from 'react';\nexport function run() { helper(); inner(); this.q(); o.m();\n function inner() { run(); } }\nclass K { go() { this.stop(); } stop() { return other(); } }\n",
    "src/b.js": "export function helper() { return helper; }\n",
    "src/c.js": "export function helper() {}\n",
    "lib/t.ts": "import { one } from './u.js';\nimport { z } from '../src/b';\nexport const f = async (a: number): Promise<void> => { one(); z(); };\n",
    "lib/u.ts": "export function one(): void;\nexport function one(a?: string): void { one(); }\nexport enum E { A }\n",
    "p/m.py": "import util\nfrom p import q\ndef g():\n    util.h()\n    k()\ndef k(): pass\n",
    "p/util.py": "def h(): pass\n",
    "node_modules/x/i.js": "function no() {}",
    "src/x.min.js": "function no() {}",
    "src/bin.js": "a\0b",
    "src/bad.js": "function ok() { return f(1); }\nfunction broken( {\nfunction fine() {}\n",
    "src/notes.txt": "no code",
}


def _units(spark):
    rows = [(p, len(t), bytearray(t.encode())) for p, t in FILES.items()]
    found = files.parse(spark.createDataFrame(rows, "path string, length long, content binary"))
    return found.withColumn("repository_id", F.lit("r")).withColumn("commit_sha", F.lit("c")).cache()


def test_graph(spark):
    units = _units(spark)
    names = {r.unit_id: (r.path, r.qualified_name) for r in units.collect()}
    edges, missing, outside = code_graph.build(units)
    calls = {(names[e.source][1], *names[e.target], e.resolution) for e in edges.where("kind = 'CALLS'").collect()}
    assert calls == {
        ("run", "src/b.js", "helper", "import_export"),
        ("run", "src/a.js", "run.inner", "nested_scope"),
        ("run.inner", "src/a.js", "run", "same_file"),
        ("K.go", "src/a.js", "K.stop", "this_method"),
        ("f", "lib/u.ts", "one", "import_export"),
        ("one", "lib/u.ts", "one", "recursion"),
        ("g", "p/m.py", "k", "same_file"),
    }
    assert {(names[r.unit_id][1], r.name, r.reason) for r in missing.collect()} == {
        ("run", "this.q", "dynamic receiver"), ("run", "o.m", "dynamic receiver"), ("K.stop", "other", "external or unknown symbol"),
        ("f", "z", "external or unknown symbol"), ("g", "util.h", "dynamic receiver"), ("ok", "f", "external or unknown symbol"),
    }
    assert {(r.path, r.spec) for r in outside.collect()} == {("src/a.js", "react"), ("p/m.py", "p")}
    imports = {(names[e.source][0], names[e.target][0]) for e in edges.where("kind = 'IMPORTS'").collect()}
    assert imports == {("src/a.js", "src/b.js"), ("lib/t.ts", "lib/u.ts"), ("lib/t.ts", "src/b.js"), ("p/m.py", "p/util.py")}
    inside = {(names[e.source][1], names[e.target][1]) for e in edges.where("kind = 'CONTAINS'").collect()}
    assert inside == {("run", "run.inner"), ("K", "K.go"), ("K", "K.stop")}


def test_coverage_and_skips(spark):
    row = files.coverage(_units(spark)).first()
    assert (row.seen, row.parsed, row.partial, row.failed, row.skipped) == (10, 7, 1, 0, 2)
    assert row.skip_reasons == {"binary_content": 1, "generated_bundle": 1} and row.by_language == {"JavaScript": 4, "TypeScript": 2, "Python": 2}
    assert row.ratio == 1.0


def test_paths_and_call_order(spark):
    got = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/../../b",), ("./",)], "p string").select(code_graph.normal_path(F.col("p")).alias("n"))
    assert [r.n for r in got.collect()] == ["a/c", "../x", "../b", ""]
    units = _units(spark)
    assert [(r.qualified_name, r.observed_order) for r in code_graph.call_order(units, "helper", "`q`()").collect()] == [("run", "before")]
    assert [r.observed_order for r in code_graph.call_order(units, "m", "helper").collect()] == ["after"]


def test_script_forms():
    text = """/** Doc. */
export default class { static async a() { new B(); } b = x => c(x); get d() { return 1; } }
A.prototype.run = function () { go(); };
module.exports.named = () => `t ${tpl(1)} } ${'}'}`;
const o = { m() { y(); }, p: async () => z(), q: 1 };
exports.w = w;
app.post('/u/:id', auth, async (req, res) => { save(/a\\/[/]b/.test(s)); });
"""
    got = {u.qualified_name: [c["name"] for c in u.call_sites] for u in script_units.analyze("f.js", text.encode(), "JavaScript")}
    assert got == {"f.js": [], "default": [], "default.a": ["B"], "default.b": ["c"], "default.d": [], "A.run": ["go"], "named": ["tpl"], "o.m": ["y"], "o.p": ["z"], "app.post('/u/:id')": ["save", "*.test"]}
