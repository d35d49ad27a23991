"""The code graph over unit tables: containment, exports, imports and calls, all equi-joins on (version, path, name).

Every lookup side is reduced to one row a key before it is joined, so no rule multiplies call sites.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cascade

KEYS = ("repository_id", "commit_sha")
# What an import's path may lack, in the order in which it is tried.
SUFFIXES = ("", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".mts", ".cts", "/index.js", "/index.mjs", "/index.jsx", "/index.ts", "/index.tsx")
TYPED = (".ts", ".tsx", ".mts", ".cts")
DYNAMIC = r"^[a-z_$][\w$]*\."


def normal_path(path: Column) -> Column:
    """A relative path without empty, . and inner .. parts."""
    up = lambda done, part: (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
    step = lambda done, part: F.when(up(done, part), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    kept = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    # An empty array has no last element; a sentinel keeps element_at defined and is cut off at the end.
    return F.array_join(F.slice(F.aggregate(kept, F.array(F.lit("..")), step), 2, 1 << 20), "/")


def place(order: Column) -> Column:
    """Sort key of an edge: the folders of its file, its unit, its place in the unit."""
    return F.struct(F.split("path", "/").alias("p"), F.col("ord").alias("u"), order.alias("s"))


def _edge(kind: str, how: Column, line: Column, order: Column) -> list[Column]:
    return [F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), how.alias("resolution"), line.cast("int").alias("line"), place(order).alias("ord")]


def containers(units: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """CONTAINS edges from a unit's parent, the first of that name in its file; DEFINES from the file without one."""
    fine = units.where("unit_type <> 'file'")
    named = fine.groupBy(*keys, "path", F.col("qualified_name").alias("parent")).agg(F.min_by("unit_id", "ord").alias("_p"))
    whole = units.where("unit_type = 'file'").select(*keys, "path", F.col("unit_id").alias("_f"))
    linked = fine.join(named, [*keys, "path", "parent"], "left").join(whole, [*keys, "path"], "left")
    kind = F.when(F.col("_p").isNotNull(), "CONTAINS").otherwise("DEFINES")
    out = linked.select(*keys, F.coalesce("_p", "_f").alias("source"), F.col("unit_id").alias("target"), *_edge(kind, F.lit("syntax"), F.lit(None), F.lit(0)))
    return out.where("source IS NOT NULL AND source <> target")


def export_index(units: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(path, name, unit_id): the last unit exported by a name; a unit's own name only where none is exported by it."""
    each = units.where("unit_type <> 'file' AND size(exports) > 0").select(*keys, "path", "ord", "name", "unit_id", F.explode("exports").alias("out"))
    said = each.select(*keys, "path", F.col("out").alias("name"), "unit_id", F.lit(1).alias("told"), "ord")
    own = each.select(*keys, "path", "name", "unit_id", F.lit(0).alias("told"), -F.col("ord"))
    return said.union(own).groupBy(*keys, "path", "name").agg(F.max_by("unit_id", F.struct("told", "ord")).alias("unit_id"))


def exports(units: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    whole = units.where("unit_type = 'file'").select(*keys, "path", F.col("unit_id").alias("source"))
    each = units.where("unit_type <> 'file'").select(*keys, "path", "ord", F.col("unit_id").alias("target"), F.posexplode("exports").alias("_i", "_n"))
    return each.join(whole, [*keys, "path"]).select(*keys, "source", "target", *_edge("EXPORTS", F.lit("syntax"), F.lit(None), F.col("_i")))


def imports(units: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(path, spec, at, target): the file that each import of each file means; null for what lies outside.

    Python modules known by no full path may match the end of a path; the first path by order is taken.
    """
    files = units.where("unit_type = 'file' AND status <> 'skipped'").select(*keys, "path", "language", "imports")
    specs = files.select(*keys, "path", "language", F.posexplode("imports").alias("at", "spec"))
    script = F.col("language").isin("JavaScript", "TypeScript") & F.col("spec").startswith(".")
    base = normal_path(F.concat_ws("/", F.regexp_replace("path", "/?[^/]*$", ""), "spec"))
    stem = F.regexp_extract(base, r"^(.*)\.(?:js|jsx|mjs|cjs)$", 1)
    tried = F.array(*[F.concat(base, F.lit(s)) for s in SUFFIXES])
    typed = F.when((F.col("language") == "TypeScript") & (stem != ""), F.array(*[F.concat(stem, F.lit(s)) for s in TYPED])).otherwise(F.array().cast("array<string>"))
    module = F.replace("spec", F.lit("."), F.lit("/"))
    python = (F.col("language") == "Python") & ~F.col("spec").isin("", ".")
    options = F.when(script, F.concat(tried, typed)).when(python, F.array(F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__init__.py"))))
    full = specs.select(*keys, "path", "spec", F.posexplode(options).alias("_o", "_c")).join(files.select(*keys, F.col("path").alias("_c"), F.col("path").alias("target")), [*keys, "_c"])
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1 << 20), "/"))
    tails = files.where("path LIKE '%/%.py'").select(*keys, F.explode(ends).alias("_c"), F.col("path").alias("target")).groupBy(*keys, "_c").agg(F.min("target").alias("target"))
    tail = specs.where(python).select(*keys, "path", "spec", F.lit(99).alias("_o"), F.concat(module, F.lit(".py")).alias("_c")).join(tails, [*keys, "_c"])
    best = full.unionByName(tail).groupBy(*keys, "path", "spec").agg(F.min_by("target", "_o").alias("target"))
    return specs.join(best, [*keys, "path", "spec"], "left").select(*keys, "path", "spec", "at", "target")


def import_edges(units: DataFrame, found: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    whole = units.where("unit_type = 'file'").select(*keys, "path", "ord", F.col("unit_id").alias("source"))
    to = whole.select(*keys, F.col("path").alias("target_path"), F.col("source").alias("target"))
    linked = found.where("target IS NOT NULL").withColumnRenamed("target", "target_path").join(whole, [*keys, "path"]).join(to, [*keys, "target_path"])
    return linked.where("source <> target").select(*keys, "source", "target", *_edge("IMPORTS", F.lit("module_path"), F.lit(None), F.col("at")))


def calls(units: DataFrame, found: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Each call site with the unit that it means and the rule that told, both null where none did.

    Bare names: nested, then beside, then in the file, then the one export of that name among the imported files (an
    import that two specifiers mean counts twice). this.x in a method: the one of that name in its class. Dotted
    names: the one of that name in the file and those it imports. Starred names never.
    """
    fine = units.where("unit_type <> 'file'")
    site = fine.select(*keys, "path", "ord", "unit_id", "unit_type", "qualified_name", "parent", F.explode("call_sites").alias("_s"))
    site = site.select("*", F.col("_s.name").alias("name"), F.col("_s.line").alias("line"), F.col("_s.order").alias("order")).drop("_s")
    members = fine.groupBy(*keys, "path", F.coalesce("parent", F.lit("")).alias("_in"), "name").agg(F.max_by("unit_id", "ord").alias("_m"))
    dotted, starred = F.col("name").contains("."), F.col("name").startswith("*")
    bare = ~dotted & ~starred

    def look(rows: DataFrame, where: Column, out: str) -> DataFrame:
        return rows.withColumn("_in", F.when(bare, where)).join(members.withColumnRenamed("_m", out), [*keys, "path", "_in", "name"], "left").drop("_in")

    site = look(site, F.col("qualified_name"), "_nested")
    site = look(site, F.nullif("parent", F.lit("")), "_beside")
    site = look(site, F.lit(""), "_local")
    given = export_index(units, keys).withColumnsRenamed({"path": "target", "unit_id": "_x"})
    seen = found.where("target IS NOT NULL").select(*keys, "path", "target")
    shared = seen.join(given, [*keys, "target"]).groupBy(*keys, "path", "name").agg(F.count("*").alias("_n"), F.first("_x").alias("_import")).where("_n = 1").drop("_n")
    site = site.join(shared, [*keys, "path", "name"], "left").withColumn("_import", F.when(bare, F.col("_import")))
    this = F.col("name").startswith("this.") & (F.col("unit_type") == "method") & F.col("parent").isNotNull() & (F.size(F.split("name", r"\.")) == 2)
    only = fine.groupBy(*keys, "path", F.col("qualified_name").alias("_q")).agg(F.count("*").alias("_n"), F.first("unit_id").alias("_this")).where("_n = 1").drop("_n")
    site = site.withColumn("_q", F.when(this, F.concat("parent", F.lit("."), F.expr("substring(name, 6)")))).join(only, [*keys, "path", "_q"], "left").drop("_q")
    reach = seen.distinct().union(units.select(*keys, "path", F.col("path").alias("target"))).distinct()
    wanted = site.where(dotted & ~starred).select(*keys, "path", "name").distinct()
    known = fine.select(*keys, F.col("path").alias("target"), F.col("qualified_name").alias("name"), F.col("unit_id").alias("_d")).where("name LIKE '%.%'")
    one = wanted.join(known, [*keys, "name"]).join(reach, [*keys, "path", "target"]).groupBy(*keys, "path", "name").agg(F.count("*").alias("_n"), F.first("_d").alias("_dotted")).where("_n = 1").drop("_n")
    site = site.join(one, [*keys, "path", "name"], "left").withColumn("_dotted", F.when(~this, F.col("_dotted")))
    other = F.when(F.col("_local") != F.col("unit_id"), F.col("_local"))
    target, rule = cascade([("nested_scope", F.col("_nested")), ("enclosing_scope", F.col("_beside")), ("same_file", other), ("recursion", F.col("_local")), ("import_export", F.col("_import")), ("this_method", F.col("_this")), ("qualified_name", F.col("_dotted"))])
    return site.select(*keys, "path", "ord", "unit_id", "name", "line", "order", target.alias("target"), rule.alias("resolution"))


def unresolved(resolved: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    dynamic = F.col("name").startswith("*") | F.col("name").rlike(DYNAMIC)
    reason = F.when(dynamic, "dynamic receiver").otherwise("external or unknown symbol")
    return resolved.where("target IS NULL").select(*keys, "unit_id", "name", "line", reason.alias("reason"))


def build(units: DataFrame, keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, unresolved calls, imports from outside) of all versions in the table."""
    found = imports(units, keys)
    sites = calls(units, found, keys)
    called = sites.where("target IS NOT NULL").select(*keys, F.col("unit_id").alias("source"), "target", *_edge("CALLS", F.col("resolution"), F.col("line"), F.col("order")))
    edges = reduce(DataFrame.unionByName, [containers(units, keys), exports(units, keys), import_edges(units, found, keys), called])
    return edges, unresolved(sites, keys), found.where("target IS NULL").select(*keys, "path", "spec")


def call_order(units: DataFrame, first: str, second: str) -> DataFrame:
    """Units that call both names, by which of them comes first in the source; a name's last part is enough.

    Equal places (both names mean one call) tell "after".
    """

    def site(wanted: str) -> Column:
        wanted = wanted.strip("`'\"() ").lower()
        name = lambda s: F.lower(s["name"])
        hits = F.filter("call_sites", lambda s: (name(s) == wanted) | (F.element_at(F.split(name(s), r"\."), -1) == wanted.rsplit(".", 1)[-1]))
        return F.get(hits, F.lit(0))

    both = units.withColumn("_a", site(first)).withColumn("_b", site(second)).where("_a IS NOT NULL AND _b IS NOT NULL")
    relation = F.when(F.col("_a.order") < F.col("_b.order"), "before").otherwise("after")
    return both.select("unit_id", "qualified_name", "path", F.col("_a").alias("first_call"), F.col("_b").alias("second_call"), relation.alias("observed_order"), F.when(relation == "before", 1.0).otherwise(0.5).alias("score"))
