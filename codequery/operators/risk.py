"""Rule scanning, range joins of findings to spans, and risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of dangerous code (case-insensitive) with their severity.
RULES = (
    ("R001", "HIGH", r"""(?:execute|executemany)\s*\(\s*(?:f["']|.*%|.*\.format\()"""),
    ("R002", "HIGH", r"""\b(?:eval|exec)\s*\("""),
    ("R003", "MEDIUM", r"""subprocess\.(?:call|run|Popen).*shell\s*=\s*True"""),
    ("R004", "CRITICAL", r"""(?:api[_-]?key|secret|password|access[_-]?token)\s*=\s*["'][^"']{8,}"""),
    ("R005", "HIGH", r"""-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"""),
)
# Phrases that try to instruct whoever reads the text.
INJECTIONS = (
    r"ignore\s+(?:all\s+)?previous\s+instructions",
    r"disregard\s+(?:the\s+)?system\s+prompt",
    r"reveal\s+(?:the\s+)?system\s+prompt",
    r"exfiltrat(?:e|ion)",
    r"print\s+(?:all\s+)?(?:secrets|environment variables|credentials)",
    r"upload\s+(?:the\s+)?(?:source|repository|credentials)",
)


# What betrays a secret.
SECRETS = (
    r"""(?i)\b(?:api[_-]?key|access[_-]?token|password|secret)\b\s*[:=]\s*['"][^'"]{8,}""",
    r"""-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----""",
    r"""\bgh[pousr]_[A-Za-z0-9_]{20,}\b""",
)
SAFE_CHARS = 12_000


def secrets(text: Column) -> Column:
    """Places, from 0, of the secret patterns that a text matches."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(i)) for i, p in enumerate(SECRETS)]))


def sanitised(text: Column) -> Column:
    """The text as data for a prompt: without NUL characters and no longer than SAFE_CHARS."""
    return F.substring(F.replace(text, F.lit("\0"), F.lit("")), 1, SAFE_CHARS)


def scan_files(texts: DataFrame) -> DataFrame:
    """(path, line, rule_id, severity): every rule over every line of whole texts (path, text)."""
    split = F.split("text", "\r\n|[\n\r\u000b\f\u001c\u001d\u001e\u0085\u2028\u2029]")
    lines = texts.select("path", F.posexplode(split).alias("line", "text"))
    return scan(lines.withColumn("line", F.col("line") + 1), "text").select("path", "line", "rule_id", "severity")


def history(commits: DataFrame) -> DataFrame:
    """(path, changes, authors) of commits (sha, author, files)."""
    touched = commits.select("sha", "author", F.explode(F.array_distinct("files")).alias("path"))
    return touched.groupBy("path").agg(F.count_distinct("sha").alias("changes"), F.count_distinct("author").alias("authors"))


def repository_risk(risks: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: the mean risk of the functions; without functions ten for each finding, up to 100."""
    mean, n = risks.agg(F.avg("risk").alias("_mean")), findings.agg(F.count("*").alias("_n"))
    return mean.crossJoin(n).select(F.round(F.coalesce("_mean", F.least(F.lit(100.0), F.col("_n") * 10.0)), 1).alias("risk"))


def scan(lines: DataFrame, line: str) -> DataFrame:
    """lines with rule_id and severity, a row for each rule that a line matches."""
    hits = F.array_compact(F.array(*[F.when(F.col(line).rlike("(?i)" + p), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, p in RULES]))
    return lines.withColumn("_r", F.explode(hits)).select(*lines.columns, "_r.*")


def instructs(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in INJECTIONS))


def within(points: DataFrame, spans: DataFrame, keys: list[str], at: str, first: str, last: str, how: str = "inner") -> DataFrame:
    """Range join: points whose place lies in a span of the same keys; an equi-join with a residual condition."""
    p, s = points.alias("p"), spans.alias("s")
    on = F.col(f"p.{at}").between(F.col(f"s.{first}"), F.col(f"s.{last}"))
    for k in keys:
        on = on & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    return s.join(p, on, how)


def function_risk(complexity: Column, calls: Column, changes: Column, authors: Column, findings: Column) -> tuple[Column, Column]:
    """Score up to 100 and the reasons for it. Weights, limits and reasons are fixed values."""
    score = F.least(F.lit(100.0), (4 * complexity + 3 * calls + 2 * changes + 2 * authors + 22 * findings).cast("double"))
    told = ((complexity >= 8, "high cyclomatic complexity"), (calls >= 6, "many dependencies"), (changes >= 5, "frequently modified"), (authors >= 3, "multiple contributors"), (findings > 0, "security finding in function"))
    reasons = F.array_compact(F.array(*[F.when(c, t) for c, t in told]))
    return score, F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("low observed structural and evolution risk")))
