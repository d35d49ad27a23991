"""What a version is like: its architecture, its dependencies, its name."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCRIPTS = ("JavaScript", "TypeScript")
# Roots of imports that tell what a code base is.
SERVICES = ("express", "koa", "fastify", "@nestjs", "hapi")
FRONT_ENDS = ("react", "vue", "svelte", "@angular", "next")
PYTHON_SERVICES = ("fastapi", "flask", "django")
DATA = ("sqlalchemy", "django")


def _some(condition: Column) -> Column:
    return F.coalesce(F.max(condition.cast("int")), F.lit(0)) > 0


def architecture(units: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, architecture): the first rule that holds, of flags that aggregate without gathering any import."""
    files = units.where("unit_type = 'file' AND status <> 'skipped'")
    python = F.transform("imports", lambda m: F.get(F.split(m, r"\."), F.lit(0)))
    script = F.transform("imports", lambda m: F.get(F.split(F.regexp_replace(m, "^node:", ""), "/"), F.lit(0)))
    meets = lambda roots, known: F.arrays_overlap(roots, F.array(*[F.lit(k) for k in known]))
    is_script = F.col("language").isin(*SCRIPTS)
    flags = {
        "service": is_script & meets(script, SERVICES),
        "front": is_script & meets(script, FRONT_ENDS),
        "typed": F.col("language") == "TypeScript",
        "script": F.col("language") == "JavaScript",
        "python": F.col("language") == "Python",
        "web": meets(python, PYTHON_SERVICES),
        "data": meets(python, DATA),
        "cli": F.lower("path").contains("cli"),
    }
    seen = files.groupBy(*keys).agg(*[_some(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
    rules = (("service", "JavaScript web service / API"), ("front", "JavaScript front-end application"), ("typed AND NOT python", "modular TypeScript application"), ("script AND NOT python", "modular JavaScript application"), ("web", "web service / API"), ("data", "data-backed application"), ("cli", "command-line application"))
    label = reduce(lambda rest, r: F.when(F.expr(r[0]), r[1]).otherwise(rest), reversed(rules), F.lit("modular Python application"))
    return seen.select(*keys, label.alias("architecture"))


def dependencies(units: DataFrame, limit: int = 100) -> DataFrame:
    """(root): the first distinct roots of imports, by name."""
    roots = units.where("unit_type = 'file'").select(F.explode("imports").alias("m")).select(F.get(F.split("m", r"\."), F.lit(0)).alias("root"))
    return roots.distinct().orderBy("root").limit(limit)


def display_name(source: Column) -> Column:
    """The last part of a path or an address, without .git."""
    last = F.regexp_extract(F.regexp_replace(source, "/+$", ""), "([^/:]*)$", 1)
    name = F.regexp_replace(last, r"\.git$", "")
    return F.when(name == "", source).otherwise(name)


def source_of(place: str) -> str:
    """The place of a code base, checked: a folder's path, or an https, ssh or git@ address without credentials."""
    place = place.strip()
    if not place:
        raise ValueError("a source is needed")
    scheme, _, rest = place.partition("://")
    if not rest:
        if not place.startswith("git@") and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:(?!/)", place):
            raise ValueError("only folders and https, ssh or git@ addresses can be read")
        return place
    if scheme not in ("https", "ssh", "file", "hdfs", "s3a", "gs", "abfss", "viewfs"):
        raise ValueError("only folders and https, ssh or git@ addresses can be read")
    if scheme == "https" and "@" in rest.split("/", 1)[0]:
        raise ValueError("an address must not hold credentials")
    return place
