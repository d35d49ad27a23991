"""Python sources to canonical code units, one file a row, faults kept to their file."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame

from .units import SCHEMA, Unit, clipped, dynamic_note, numbered, parsed, sites, unit_id

__all__ = ["SCHEMA", "analyze", "parse", "read", "unit_id", "units"]

MAX_BYTES = 512_000
# Nodes that add one to the complexity.
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.comprehension)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
ROUTES = {"get", "post", "put", "patch", "delete", "route", "api_route"}


def dotted(node: ast.AST) -> str | None:
    """a.b.c of a chain of attributes; what hangs on an unnamed value keeps its attributes alone."""
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        names.append(node.id)
    return ".".join(reversed(names)) or None


def called(node: ast.AST) -> list[tuple]:
    """(name, line) of all calls under a node by line and column; name is None for unnamed ones."""
    found = [(c.lineno, c.col_offset, dotted(c.func)) for c in ast.walk(node) if isinstance(c, ast.Call)]
    return [(name, line) for line, _, name in sorted(found, key=lambda x: x[:2])]


def complexity(node: ast.AST) -> int:
    return 1 + sum(len(n.values) - 1 if isinstance(n, ast.BoolOp) else isinstance(n, BRANCHES) for n in ast.walk(node))


def imports(tree: ast.AST) -> list[str]:
    found = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            found |= {a.name for a in n.names}
        elif isinstance(n, ast.ImportFrom):
            found.add(n.module or ".")
    return sorted(found)


def exports(tree: ast.Module) -> list[str]:
    """__all__ where it is a literal list, else the public functions and classes."""
    for n in tree.body:
        if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)):
            return [e.value for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    return [n.name for n in tree.body if isinstance(n, (*FUNCTIONS, ast.ClassDef)) and not n.name.startswith("_")]


def routes(node: ast.AST) -> list[str]:
    """VERB path of each decorator that routes requests to a function."""
    found = []
    for d in node.decorator_list:
        verb = (dotted(d.func) or "").split(".")[-1].lower() if isinstance(d, ast.Call) else ""
        if verb in ROUTES:
            first = d.args[0] if d.args else None
            found.append(f"{verb.upper()} {first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else ''}".strip())
    return found


def heading(node: ast.AST) -> str:
    if isinstance(node, ast.ClassDef):
        inside = ", ".join(ast.unparse(b) for b in node.bases)
        return f"class {node.name}({inside})" if inside else f"class {node.name}"
    word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    return f"{word} {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


def analyze(path: str, data: bytes | None) -> list[Unit]:
    """Units of a file; a file that can't be read or parsed gives one with its status."""
    base = {"language": "Python"}

    def alone(status, reason):
        return numbered([Unit(path, 0, "", "file", path, name=path, status=status, reason=reason, **base)])

    for bad, reason in ((data is None, "unreadable"), (data is not None and len(data) > MAX_BYTES, "too_large"), (data is not None and b"\0" in data, "binary_content")):
        if bad:
            return alone("skipped", reason)
    try:
        text = data.decode("utf-8-sig")
        tree = ast.parse(text)
        return numbered(_found(path, text, tree, base))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as fault:
        return alone("failed", f"{type(fault).__name__}: {fault}"[:300])


def _found(path: str, text: str, tree: ast.Module, base: dict) -> list[Unit]:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    needs = imports(tree)
    body, note = clipped(text)
    known = {"path": path, "ord": 0, "unit_id": "", "imports": needs, **base}
    out = [Unit(unit_type="file", qualified_name=path, name=path.rsplit("/", 1)[-1].removesuffix(".py"), line_end=max(1, len(lines) - (lines[-1] == "")), docstring=ast.get_docstring(tree), source=body, exports=exports(tree), uncertainty=note, **known)]

    public = set(exports(tree))

    def add(node, kind, name, parent, score=1):
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        methods = [m for m in node.body if isinstance(m, FUNCTIONS)] if kind == "class" else []
        calls = [c for m in methods for c in called(m)] if kind == "class" else called(node)
        kin = {"exports": [node.name] if parent is None and node.name in public else []}
        kin |= {"bases": list(map(ast.unparse, node.bases))} if isinstance(node, ast.ClassDef) else {"routes": routes(node)}
        out.append(Unit(unit_type=kind, qualified_name=name, name=node.name, parent=parent, line_start=first, line_end=node.end_lineno, docstring=ast.get_docstring(node), signature=heading(node), source="\n".join(lines[first - 1 : node.end_lineno]), calls=sorted({n for n, _ in calls if n}), call_sites=[] if kind == "class" else sites(calls), uncertainty=[] if kind == "class" else dynamic_note(sum(n is None for n, _ in calls)), complexity=score, **kin, **known))

    for node in tree.body:
        if isinstance(node, FUNCTIONS):
            add(node, "function", node.name, None, score=complexity(node))
        elif isinstance(node, ast.ClassDef):
            add(node, "class", node.name, None)
            for inner in node.body:
                if isinstance(inner, FUNCTIONS):
                    add(inner, "method", f"{node.name}.{inner.name}", node.name, score=complexity(inner))
    return out


def parse(path: str, data: bytes | None) -> list[tuple]:
    """Unit rows of a file."""
    return [u.row() for u in analyze(path, data)]


def units(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Units of a table of files, such as spark.read.format("binaryFile") gives."""
    return parsed(files, analyze, path, content)


def read(spark, root: str) -> DataFrame:
    """Units of the Python files under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root)
    return units(found)
