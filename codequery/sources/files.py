"""Source files: which are read, in what order, in which language, and why others are skipped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import python_units, script_units, units

# Folders that are never searched, files that are built from others, and languages by extension.
EXCLUDED = (
    ".git",
    ".hg",
    ".svn",
    ".venv",
    "venv",
    "env",
    "node_modules",
    "bower_components",
    "dist",
    "build",
    "out",
    "coverage",
    "__pycache__",
    ".tox",
    ".mypy_cache",
    ".pytest_cache",
    ".next",
    ".nuxt",
    ".cache",
    "vendor",
    "target",
    ".turbo",
    ".parcel-cache",
)
# What the scan for secrets and dangerous code reads, and the folders that it leaves out.
SCANNED = (".py", ".js", ".ts", ".tsx", ".json", ".yaml", ".yml", ".env", ".toml", ".ini")
UNSCANNED = (".git", ".venv", "venv", "node_modules", "dist", "build", "__pycache__")
BUNDLES = (".min.js", ".bundle.js", ".chunk.")
LANGUAGES = {"Python": (".py",), "JavaScript": (".js", ".jsx", ".mjs", ".cjs"), "TypeScript": (".ts", ".tsx", ".mts", ".cts")}
MAX_BYTES = 512_000


def language(path: Column) -> Column:
    suffix = F.concat(F.lit("."), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))
    return reduce(lambda out, x: F.when(suffix.isin(*x[1]), x[0]).otherwise(out), LANGUAGES.items(), F.lit(None).cast("string"))


def contained(path: Column) -> Column:
    """Whether a relative path stays below its root."""
    return (path != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def skip_reason(path: Column, length: Column) -> Column:
    low = F.lower(path)
    bundle = reduce(lambda a, b: a | b, [low.contains(b) if b.endswith(".") else low.endswith(b) for b in BUNDLES])
    return F.when(bundle, "generated_bundle").when(length.isNull(), "unreadable").when(length > MAX_BYTES, "too_large")


def candidates(files: DataFrame) -> DataFrame:
    """(path, length, content) of source files with language and reason; path is relative to the root."""
    folders = F.split("path", "/")
    outside = ~F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*[F.lit(e) for e in EXCLUDED]))
    kept = files.where(outside & contained(F.col("path"))).withColumn("language", language(F.col("path"))).where("language is not null")
    return kept.withColumn("reason", skip_reason(F.col("path"), F.col("length")))


def _parse(path: str, lang: str, reason: str | None, data: bytes | None) -> list[units.Unit]:
    if reason:
        return units.numbered([units.Unit(path, 0, "", "file", path, name=path, language=lang, status="skipped", reason=reason)])
    return python_units.analyze(path, data) if lang == "Python" else script_units.analyze(path, data, lang)


def parse(files: DataFrame, repository: str = "", commit: str = "") -> DataFrame:
    """Units of (path, length, content); a fault is kept to its file. Skipped files' bytes never reach Python.

    Ids hold the repository and the commit, so that no two versions share one.
    """
    found = candidates(files).withColumn("content", F.when(F.col("reason").isNull(), F.col("content")))
    return units.parsed(found, lambda *row: units.numbered(_parse(*row), repository, commit), "path", "language", "reason", "content")


def scannable(files: DataFrame) -> DataFrame:
    """(path, text) of the files that the scan for secrets reads, whole; bytes that are no UTF-8 are left out."""
    folders = F.split("path", "/")
    suffix = F.regexp_extract(F.element_at(folders, -1), r"(?s)^.+(\.[^.]*)$", 1)
    inside = ~F.arrays_overlap(folders, F.array(*[F.lit(e) for e in UNSCANNED]))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\ufffd", "")
    return files.where(inside & suffix.isin(*SCANNED) & F.col("content").isNotNull()).select("path", text.alias("text"))


def documentation(files: DataFrame) -> DataFrame:
    """(path, text) of README files at the root, as documents beside the units."""
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\ufffd", "")
    return files.where(F.col("path").isin("README.md", "README.rst")).select("path", text.alias("text"))


def relative(files: DataFrame, root: str) -> DataFrame:
    """Binary-file rows with path made relative to the root."""
    base = root.rstrip("/").removeprefix("file:") + "/"
    plain = F.regexp_replace("path", "^file:/*", "/")
    return files.withColumn("path", F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 1 << 20)).otherwise(F.regexp_replace("path", "^.*?" + "\\Q" + base + "\\E", "")))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of all files below a folder."""
    return relative(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), root).select("path", "length", "content")


def read(spark: SparkSession, root: str, repository: str = "", commit: str = "") -> DataFrame:
    return parse(scan(spark, root), repository, commit)


def coverage(found: DataFrame) -> DataFrame:
    """One row: files seen, by status, their units, the ratio parsed of those attempted, languages and skip reasons."""
    status = F.col("status")
    per = found.where("unit_type = 'file'").select("status", "language", "reason").withColumn("_u", F.lit(0))
    counts = per.agg(F.count("*").alias("seen"), *[F.count_if(status == s).alias(n) for s, n in (("ok", "parsed"), ("partial", "partial"), ("failed", "failed"), ("skipped", "skipped"))])
    tried = F.col("seen") - F.col("skipped")
    tally = lambda rows, key: rows.groupBy(key).count().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "count")))))
    langs = tally(per.where("status <> 'skipped'"), "language").toDF("by_language")
    reasons = tally(per.where("status = 'skipped'"), "reason").toDF("skip_reasons")
    n = found.where("unit_type <> 'file'").agg(F.count("*").alias("units"))
    out = counts.withColumn("ratio", F.when(tried == 0, 0.0).otherwise(F.round((F.col("parsed") + F.col("partial")) / tried, 4)))
    return out.crossJoin(n).crossJoin(langs).crossJoin(reasons)
