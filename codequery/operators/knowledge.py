"""The knowledge graph over unit tables: repositories, files, libraries, classes, functions, endpoints and entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .code_graph import KEYS
from .graph import reach

FUNCTIONS = ("function", "method")


def _kind(name: str, key: Column) -> Column:
    return F.concat(F.lit(name + ":"), key)


def _has(*words: str) -> Column:
    one = lambda w: F.exists("bases", lambda base: base.contains(w))
    return reduce(lambda a, b: a | b, [one(w) for w in words])


def _parts(units: DataFrame) -> dict[str, DataFrame]:
    """Rows of units by what they stand for, each with its node's id."""
    ok = units.where("status <> 'skipped'")
    fns = ok.where(F.col("unit_type").isin(*FUNCTIONS)).withColumn("id", F.col("unit_id"))
    classes = ok.where("unit_type = 'class'").withColumn("id", F.col("unit_id"))
    library = F.explode(F.transform("imports", lambda m: F.get(F.split(m, r"\."), F.lit(0))))
    return {
        "FILE": ok.where("unit_type = 'file'").withColumn("id", _kind("file", F.col("path"))),
        "LIBRARY": ok.where("unit_type = 'file'").withColumn("lib", library).where("lib <> ''").withColumn("id", _kind("library", F.col("lib"))),
        "CLASS": classes,
        "FUNCTION": fns,
        "API_ENDPOINT": fns.withColumn("route", F.explode("routes")).withColumn("id", _kind("endpoint", F.concat_ws(" ", "route", "unit_id"))),
        "DATABASE_ENTITY": classes.where(_has("Base")).withColumn("id", _kind("entity", F.col("unit_id"))),
        "FRAMEWORK_COMPONENT": classes.where(_has("FastAPI", "APIRouter")).withColumn("id", _kind("component", F.col("unit_id"))),
    }


def nodes(units: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(id, kind, name), one row a node. Libraries are the first parts of imports, distinct in a version."""
    name = {"FILE": "path", "LIBRARY": "lib", "API_ENDPOINT": "route"}
    each = [rows.select(*keys, "id", F.lit(kind).alias("kind"), F.col(name.get(kind, "qualified_name")).alias("name")) for kind, rows in _parts(units).items()]
    roots = units.select(*keys).distinct().select(*keys, _kind("repository", F.col(keys[0])).alias("id"), F.lit("REPOSITORY").alias("kind"), F.col(keys[0]).alias("name"))
    return reduce(DataFrame.unionByName, each, roots).dropDuplicates([*keys, "id"])


def searched(found: DataFrame, term: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Nodes whose name holds the term in any case, of the kinds if any are named."""
    hit = F.lower("name").contains(term.lower())
    return found.where(hit & F.col("kind").isin(*kinds) if kinds else hit)


def exported(found: DataFrame, links: DataFrame, limit: int, order: tuple[str, ...] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """The first nodes by order, and the edges with both ends among them."""
    some = found.orderBy(*order).limit(limit)
    ends = [some.select(F.col("id").alias(c)) for c in ("source", "target")]
    return some, links.join(ends[0], "source", "left_semi").join(ends[1], "target", "left_semi").select(*links.columns)


def asked(found: DataFrame, links: DataFrame, question: str, hops: int = 4, starts: int = 4) -> DataFrame:
    """(id, hop): what the nodes named by a question's words reach; the first few distinct nodes, by word and id, begin.

    The question's words are few; nodes meet them by one join.
    """
    spark = found.sparkSession
    words = spark.createDataFrame([(i, w.lower()) for i, w in enumerate(question.split())], "at int, word string")
    named = found.where(F.col("kind").isin("FUNCTION", "CLASS", "FILE", "API_ENDPOINT"))
    hit = named.join(F.broadcast(words), F.lower("name").contains(F.col("word"))).groupBy("id").agg(F.min("at").alias("at"))
    return reach(links, hit.orderBy("at", "id").limit(starts).select("id"), hops)


def edges(units: DataFrame, code_edges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(source, target, kind), distinct. A call counts where both ends are functions; a base links to the first function of its name."""
    part = _parts(units)
    link = lambda rows, a, b, kind: rows.select(*keys, a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"))
    own, file = F.col("id"), _kind("file", F.col("path"))
    inside = part["FUNCTION"].where("unit_type = 'method'").join(part["CLASS"].groupBy(*keys, "path", F.col("qualified_name").alias("parent")).agg(F.min_by("unit_id", "ord").alias("_c")), [*keys, "path", "parent"])
    named = part["FUNCTION"].groupBy(*keys, F.col("qualified_name").alias("_base")).agg(F.min_by("unit_id", F.struct("path", "ord")).alias("_t"))
    kin = part["CLASS"].withColumn("_base", F.explode("bases")).join(named, [*keys, "_base"])
    fns = part["FUNCTION"].select(*keys, F.col("id").alias("source"))
    calls = code_edges.where("kind = 'CALLS'").select(*keys, "source", "target", "kind").join(fns, [*keys, "source"], "left_semi").join(fns.withColumnRenamed("source", "target"), [*keys, "target"], "left_semi")
    found = [
        link(part["FILE"], _kind("repository", F.col(keys[0])), own, "CONTAINS"),
        link(part["LIBRARY"], file, own, "IMPORTS"),
        link(part["CLASS"], file, own, "DEFINES"),
        link(part["FUNCTION"].where("unit_type = 'function'"), file, own, "DEFINES"),
        link(inside, F.col("_c"), own, "CONTAINS"),
        link(kin, own, F.col("_t"), "INHERITS"),
        link(part["API_ENDPOINT"], F.col("unit_id"), own, "EXPOSES"),
        link(part["DATABASE_ENTITY"], F.col("unit_id"), own, "USES"),
        link(part["FRAMEWORK_COMPONENT"], F.col("unit_id"), own, "USES"),
        calls.select(*keys, "source", "target", "kind"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()
