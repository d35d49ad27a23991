"""URL filters by a path-template tree, in DataFrame functions alone.

Rules label the urls they match; the tree judges the others. Per host, each path is a walk of segments down a
tree. A segment is generalised to the wildcard `*` where it varies: by shape (digits, with any extension kept
apart), or where its parent has many children and this one few urls. Literal branches of a parent whose
labelled purities no two-proportion test tells apart are merged into the wildcard as well. A template is
rejected where its smoothed labelled purity, shrunk level by level towards its parent's, says block.

Everything is counted before it is joined: urls first collapse to (host, segments), which no copy enlarges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: (action, host and path prefix). Fixed values of the contract.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DEPTH = 6
FEW_URLS = 8
MANY_CHILDREN = 16
Z = 1.96
PRIOR_WEIGHT = 4.0
REJECT_AT = 0.5


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without :// or for null."""
    host = F.regexp_extract(_after(url), r"(?s)^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty likewise."""
    return F.regexp_extract(_after(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule for the host or a domain above it and the start of the path."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, prefix = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + prefix)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def segments(path: Column, depth: int = DEPTH) -> Column:
    """Up to depth segments, digits generalised; deeper ones stay together as the last."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", depth)
    return F.transform(parts, lambda s: F.regexp_replace(s, r"[0-9]+|(?<![0-9A-Za-z])[0-9a-fA-F]{8,}(?![0-9A-Za-z])", "*"))


def _prefix(segs: Column, n: int) -> Column:
    return F.array_join(F.slice(segs, 1, n), "/")


def _generalised(paths: DataFrame, level: int, few: int, many: int, z: float) -> DataFrame:
    """paths (host, segs, raw, n, blocked, labelled) with segment `level` a wildcard where its branch varies or merges.

    Branches are counted first, and decided among the branches of one parent by sums over them.
    """
    here = F.size("segs") > level
    keyed = paths.withColumn("parent", F.when(here, _prefix(F.col("segs"), level))).withColumn("seg", F.when(here, F.get("segs", F.lit(level))))
    branch = keyed.where(here).groupBy("host", "parent", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "labelled")])
    totals = branch.groupBy("host", "parent").agg(F.count("*").alias("children"), *[F.sum(c).alias(f"all_{c}") for c in ("blocked", "labelled")])
    b = branch.join(totals, ["host", "parent"])
    own, rest = F.col("labelled"), F.col("all_labelled") - F.col("labelled")
    p, q = F.col("blocked") / own, (F.col("all_blocked") - F.col("blocked")) / rest
    pooled = F.col("all_blocked") / F.col("all_labelled")
    spread = F.sqrt(pooled * (1 - pooled) * (1 / own + 1 / rest))
    # alike: both sides are labelled, and differ by less than chance would
    alike = (own >= few) & (rest >= few) & (F.abs(p - q) <= z * spread)
    varies = (F.col("children") >= many) & (F.col("n") < few)
    wild = b.where((F.col("seg") != "*") & (varies | F.coalesce(alike, F.lit(False)))).select("host", "parent", "seg", F.lit(True).alias("wild"))
    out = keyed.join(wild, ["host", "parent", "seg"], "left")
    segs = F.when(F.col("wild"), F.concat(F.slice("segs", 1, level), F.array(F.lit("*")), F.slice("segs", level + 2, DEPTH))).otherwise(F.col("segs"))
    return out.select("host", segs.alias("segs"), "raw", "n", "blocked", "labelled")


def templates(urls: DataFrame, depth: int = DEPTH, few: int = FEW_URLS, many: int = MANY_CHILDREN, z: float = Z) -> DataFrame:
    """(host, raw, template, purity): for every (host, digit-generalised path) its template and smoothed share of blocks.

    urls: host, segs, action (block, allow or null). Purity at a level is (blocked + w * parent's) / (labelled + w).
    """
    counts = [F.count("*").alias("n"), F.count_if(F.col("action") == "block").alias("blocked"), F.count("action").alias("labelled")]
    paths = urls.groupBy("host", "segs").agg(*counts).withColumn("raw", F.array_join("segs", "/"))
    paths = stored(paths)
    deepest = paths.agg(F.coalesce(F.max(F.size("segs")), F.lit(0))).first()[0]
    for level in range(min(depth, deepest)):
        # a level reads the one above three times; without its own table the plan would grow as 3 ** depth
        paths = stored(_generalised(paths, level, few, many, z))
    # the purity of each prefix of each template, from the site's root down
    paths = paths.withColumn("template", F.array_join("segs", "/"))
    nodes = paths.groupBy("host", "template", "segs").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    every = nodes.select("host", "template", "blocked", "labelled", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("segs")), lambda n: _prefix(F.col("segs"), n))).alias("level", "node"))
    sums = every.groupBy("host", "level", "node").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    chain = every.select("host", "template", "level", "node").join(sums, ["host", "level", "node"])
    chain = chain.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("level", "blocked", "labelled"))).alias("chain"))
    purity = F.aggregate("chain", F.lit(0.5), lambda up, x: (x["blocked"] + PRIOR_WEIGHT * up) / (x["labelled"] + PRIOR_WEIGHT))
    return paths.select("host", "raw", "template").join(chain.select("host", "template", purity.alias("purity")), ["host", "template"])


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity): one row per input row.

    Null urls and urls without :// have empty host and path, match no rule and share the empty template; a
    template without labels near it stays at its host's purity, and an even call allows; ids may be null or
    repeat; no rows give no rows. Other columns are not read.
    """
    key = F.col(page_id).alias("page_id")
    rows = pages.select(key, F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url)), F.lit("")).alias("path"))
    rows = rows.withColumn("m", matched(F.col("host"), F.col("path"), rules)).withColumn("segs", segments(F.col("path")))
    tree = templates(rows.select("host", "segs", F.col("m.action").alias("action")))
    # written, so that the join can split a hot host's path
    out = rows.withColumn("raw", F.array_join("segs", "/")).join(stored(tree), ["host", "raw"])
    verdict = F.coalesce("m.action", F.when(F.col("purity") > REJECT_AT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("m.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() of all pages; see there for nulls, repeats and empty tables."""
    return judge(table(spark, sf_dir, "pages"))
