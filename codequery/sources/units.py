"""The canonical unit record, shared by all parsers, and the tables derived from it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE_CHARS = 20_000  # of a whole file's text, as a unit's source
SNIPPET_LINES, SNIPPET_CHARS = 60, 6_000  # of a unit's source, in a search result
BODY_CHARS = 2_400  # of a unit's source, in the text that search indexes
SITES = pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("order", pa.int32())]))
NAMES = pa.list_(pa.string())


@dataclass
class Unit:
    """One function, method, class, type or file; a file that can't be parsed is one unit with its status."""

    path: str = field(metadata={"type": pa.string()})
    ord: int = field(metadata={"type": pa.int32()})
    unit_id: str = field(metadata={"type": pa.string()})
    unit_type: str = field(metadata={"type": pa.string()})
    qualified_name: str = field(metadata={"type": pa.string()})
    parent: str | None = field(metadata={"type": pa.string()}, default=None)
    line_start: int = field(metadata={"type": pa.int32()}, default=1)
    line_end: int = field(metadata={"type": pa.int32()}, default=1)
    docstring: str | None = field(metadata={"type": pa.string()}, default=None)
    calls: list = field(metadata={"type": NAMES}, default_factory=list)
    complexity: int = field(metadata={"type": pa.int32()}, default=1)
    language: str | None = field(metadata={"type": pa.string()}, default=None)
    name: str | None = field(metadata={"type": pa.string()}, default=None)
    signature: str | None = field(metadata={"type": pa.string()}, default=None)
    source: str | None = field(metadata={"type": pa.string()}, default=None)
    imports: list = field(metadata={"type": NAMES}, default_factory=list)
    exports: list = field(metadata={"type": NAMES}, default_factory=list)
    call_sites: list = field(metadata={"type": SITES}, default_factory=list)
    bases: list = field(metadata={"type": NAMES}, default_factory=list)
    routes: list = field(metadata={"type": NAMES}, default_factory=list)
    uncertainty: list = field(metadata={"type": NAMES}, default_factory=list)
    reason: str | None = field(metadata={"type": pa.string()}, default=None)
    status: str = field(metadata={"type": pa.string()}, default="ok")

    def row(self) -> tuple:
        return tuple(getattr(self, f.name) for f in fields(self))


FIELDS = [(f.name, f.metadata["type"]) for f in fields(Unit)]
_SQL = {pa.string(): "string", pa.int32(): "int", NAMES: "array<string>", SITES: "array<struct<name:string,line:int,order:int>>"}
SCHEMA = ", ".join(f"`{n}` {_SQL[t]}" for n, t in FIELDS)


def unit_id(*key: str) -> str:
    return "cu_" + hashlib.sha1("\0".join(key).encode("utf-8", "surrogatepass")).hexdigest()[:24]


def numbered(found: list[Unit], repository: str = "", commit: str = "") -> list[Unit]:
    """Units in their order of lines with ids that tell versions, and repeated symbols of a file, apart."""
    seen: dict[tuple, int] = {}
    for at, u in enumerate(found):
        key = (u.unit_type, u.qualified_name)
        u.ord, u.unit_id = at, unit_id(repository, commit, u.path, *key, str(seen.setdefault(key, 0)))
        seen[key] += 1
    return found


def sites(found: list[tuple]) -> list[dict]:
    """Call sites from (name, line) pairs in order; nameless ones are left out and take no place."""
    named = [(n, line) for n, line in found if n]
    return [{"name": n, "line": line, "order": i} for i, (n, line) in enumerate(named)]


def dynamic_note(count: int) -> list[str]:
    return [f"{count} call(s) on dynamic expressions not resolved"] if count else []


def clipped(text: str) -> tuple[str, list[str]]:
    """A file's text up to the limit of file units, with a note when some of it is left out."""
    return (text, []) if len(text) <= FILE_CHARS else (text[:FILE_CHARS], [f"file text truncated to {FILE_CHARS} characters"])


def to_batch(found: list[Unit]) -> pa.RecordBatch:
    rows = [u.row() for u in found]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(FIELDS)], [n for n, _ in FIELDS])


def parsed(files: DataFrame, parser, *columns: str) -> DataFrame:
    """Units of a table of files: parser(*columns) gives the units of one. Batches go out file by file, so memory is one file's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield to_batch(parser(*(batch.column(c)[i].as_py() for c in range(len(columns)))))

    return files.select(*columns).mapInArrow(work, SCHEMA)


def retrieval_units(units: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Units that search returns: all finer ones, and files that hold none and aren't blank."""
    fine = units.where(F.col("unit_type") != "file")
    whole = units.where((F.col("unit_type") == "file") & (F.trim(F.coalesce("source", F.lit(""))) != ""))
    return fine.unionByName(whole.join(fine.select(*keys).distinct(), list(keys), "left_anti"))


def document_text() -> Column:
    """The text of a unit that search embeds; an empty signature or docstring leaves no line."""
    head = F.concat_ws(" ", "language", "unit_type", "qualified_name")
    body = F.substring(F.coalesce("source", F.lit("")), 1, BODY_CHARS)
    return F.concat_ws("\n", head, F.concat(F.lit("file: "), F.col("path")), F.nullif(F.col("signature"), F.lit("")), F.nullif(F.col("docstring"), F.lit("")), body)


def snippet(text: Column, first: Column) -> Column:
    """excerpt, excerpt_line_end and excerpt_truncated: at most SNIPPET_LINES lines and SNIPPET_CHARS characters, whole lines if it can."""
    every = F.split(text, "\n")
    shown = F.array_join(F.slice(every, 1, SNIPPET_LINES), "\n")
    out = F.when(F.length(shown) > SNIPPET_CHARS, F.regexp_replace(F.substring(shown, 1, SNIPPET_CHARS), r"\n[^\n]*\z", "")).otherwise(shown)
    cut = (F.size(every) > SNIPPET_LINES) | (F.length(shown) > SNIPPET_CHARS)
    return F.struct(out.alias("excerpt"), (first + F.size(F.split(out, "\n")) - 1).alias("excerpt_line_end"), cut.alias("excerpt_truncated"))


def weighted_text() -> Column:
    """The text that lexical search indexes: both names thrice; signature, docstring and path twice; all else once."""
    joined = lambda c: F.array_join(c, " ")
    twice = [F.col(c) for c in ("signature", "docstring", "path")]
    return F.concat_ws("\n", *[F.col("name"), F.col("qualified_name")] * 3, *twice, *twice, F.col("source"), joined("imports"), joined("calls"))
