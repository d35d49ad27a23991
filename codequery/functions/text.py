"""Identifier-aware tokens, stems and hashed vectors, rows first: words are exploded before they are worked on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no meaning in code search, and suffixes in the order in which they are tried.
STOP_WORDS = (
    "the",
    "a",
    "an",
    "and",
    "or",
    "of",
    "to",
    "in",
    "for",
    "on",
    "with",
    "is",
    "are",
    "be",
    "by",
    "it",
    "this",
    "that",
    "which",
    "what",
    "where",
    "how",
    "does",
    "do",
    "code",
    "function",
    "functions",
    "method",
    "file",
    "files",
    "from",
    "return",
    "returns",
    "const",
    "let",
    "var",
    "new",
    "if",
    "else",
    "async",
    "await",
    "export",
    "import",
    "def",
    "self",
)
SUFFIXES = ("ations", "ation", "ings", "ing", "ies", "ied", "ers", "er", "ed", "es", "s")
TO_Y = ("ies", "ied")
WORD = r"[A-Za-z0-9_$]+"
PART = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
BUCKETS = 256


def stem(term: Column) -> Column:
    """The term less the first suffix that leaves more than three letters."""
    out = term
    for suffix in reversed(SUFFIXES):
        cut = F.substring(term, 1, F.length(term) - len(suffix))
        out = F.when(term.endswith(suffix) & (F.length(term) > len(suffix) + 3), F.concat(cut, F.lit("y")) if suffix in TO_Y else cut).otherwise(out)
    return out


def terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term), a row for each occurrence. Null texts have none."""
    words = docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("_w"))
    parts = words.withColumn("_p", F.regexp_extract_all("_w", F.lit(PART), F.lit(0)))
    both = F.when(F.size("_p") > 1, F.concat(F.array(F.btrim("_w", F.lit("_$"))), "_p")).otherwise(F.col("_p"))
    low = parts.select(key, F.explode(both).alias("_t")).select(key, F.lower("_t").alias("_t"))
    return low.where((F.length("_t") > 1) & ~F.col("_t").isin(*STOP_WORDS)).select(key, stem(F.col("_t")).alias("term"))


def hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, weight): counts of tokens by the last byte of their MD5, scaled to length one."""
    tokens = docs.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))).alias("_t"))
    byte = F.conv(F.substring(F.md5("_t"), 31, 2), 16, 10).cast("int")
    counts = tokens.groupBy(key, "_t").agg(F.count("*").alias("_c")).groupBy(key, byte.alias("bucket")).agg(F.sum("_c").alias("_c"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("_c") * F.col("_c"))).alias("_n"))
    return counts.join(norms, key).select(key, "bucket", (F.col("_c") / F.col("_n")).alias("weight"))


def lines(text: Column) -> Column:
    """Lines by CRLF, CR or LF; an empty last one is dropped; other breaks stay inside."""
    split = F.split(text, "\r\n|\r|\n")
    return F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)


def excerpt(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last, from 1; null where the span isn't within the text."""
    ls = lines(text)
    inside = (first >= 1) & (first <= last) & (last <= F.greatest(F.size(ls), F.lit(1)))
    return F.when(inside, F.array_join(F.slice(ls, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))), "\n"))
