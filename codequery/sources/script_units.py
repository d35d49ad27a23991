"""JavaScript and TypeScript to canonical code units: a tokenizer, a bracket matcher and a walk over declarations.

No grammar is needed for units, calls, imports and exports: brackets are matched once, a walk looks at what stands
before each of them. A file whose brackets don't match is split where declarations start at the left margin; each
part that is whole gives its units, and the file is marked partial.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .units import Unit, clipped, dynamic_note, numbered, sites

MAX_BYTES = 512_000
SIGNATURE_CHARS = 300
VERBS = {"get", "post", "put", "patch", "delete", "all", "use"}
MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "declare", "*", "accessor"}
NOT_CALLS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "yield", "with", "import", "do", "else", "case", "in", "of", "new", "delete", "void", "throw", "instanceof", "super"}
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "instanceof"}
PAIRS = {"(": ")", "[": "]", "{": "}"}
NAME = re.compile(r"[#A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
SPACE = re.compile(r"\s+")
NUMBER = re.compile(r"\d[\w.]*")
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
STRING = re.compile(r"'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"")
SIGN = re.compile(r"=>|\.\.\.|\?\.(?!\d)|[=!]==?|&&|\|\||\?\?|[-+*/%&|^<>]=|\+\+|--|[\s\S]")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
TOP = re.compile(r"^(?:export|async|declare|default|abstract|function|class|const|let|var|interface|type|enum|namespace|import|module|exports)\b", re.M)


class Broken(Exception):
    """Brackets that don't match; args[0] is the line."""


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    at: int
    end: int
    line: int


def tokens(text: str, first_line: int = 1) -> tuple[list[Token], dict[int, str]]:
    """Tokens, and the JSDoc comment before each that has one. Parts of templates stand in square brackets."""
    out: list[Token] = []
    docs: dict[int, str] = {}
    open_templates: list[int] = []
    depth, at, line, counted = 0, 0, first_line, 0

    def put(kind, start, end, as_text=None):
        nonlocal line, counted
        line, counted = line + text.count("\n", counted, start), start
        out.append(Token(kind, as_text or text[start:end], start, end, line))

    def template(start):
        nonlocal depth
        stop = TEMPLATE.match(text, start).end()
        if text.startswith("${", stop):
            put("sign", stop, stop + 2, "[")
            open_templates.append(depth)
            depth = 0
            return stop + 2
        return stop + 1

    while at < len(text):
        c = text[at]
        if c.isspace():
            at = SPACE.match(text, at).end()
        elif text.startswith("//", at):
            stop = text.find("\n", at)
            at = len(text) if stop < 0 else stop
        elif text.startswith("/*", at):
            stop = text.find("*/", at + 2)
            stop = len(text) if stop < 0 else stop + 2
            if text.startswith("/**", at):
                docs[len(out)] = "\n".join(x for x in (row.strip().lstrip("*").strip() for row in text[at + 3 : stop - 2].split("\n")) if x)
            at = stop
        elif m := NAME.match(text, at):
            put("name", at, m.end())
            at = m.end()
        elif m := NUMBER.match(text, at):
            put("number", at, m.end())
            at = m.end()
        elif c in "'\"" and (m := STRING.match(text, at)):
            put("string", at, m.end())
            at = m.end()
        elif c == "`":
            put("string", at, at + 1)
            at = template(at + 1)
        elif c == "/" and _regex_may_start(out) and (m := REGEX.match(text, at)):
            put("regex", at, m.end())
            at = m.end()
        elif c == "}" and open_templates and depth == 0:
            put("sign", at, at + 1, "]")
            depth = open_templates.pop()
            at = template(at + 1)
        else:
            depth += (c == "{") - (c == "}")
            m = SIGN.match(text, at)
            put("sign", at, m.end(), "." if m.group() == "?." else None)
            at = m.end()
    return out, docs


def _regex_may_start(out: list[Token]) -> bool:
    if not out:
        return True
    last = out[-1]
    return last.text in BEFORE_REGEX if last.kind == "name" else last.kind == "sign" and last.text not in (")", "]", "}", "<", "++", "--")


def pairs(found: list[Token]) -> dict[int, int]:
    """Index of the closing bracket by that of the opening one, and back."""
    out: dict[int, int] = {}
    stack: list[int] = []
    for i, t in enumerate(found):
        if t.kind != "sign":
            continue
        if t.text in PAIRS:
            stack.append(i)
        elif t.text in (")", "]", "}"):
            if not stack or PAIRS[found[stack[-1]].text] != t.text:
                raise Broken(t.line)
            out[i] = stack.pop()
            out[out[i]] = i
    if stack:
        raise Broken(found[stack[-1]].line)
    return out


class Walk:
    """One whole text's units, imports and exports."""

    def __init__(self, path: str, language: str, text: str, first_line: int = 1):
        self.path, self.language, self.text = path, language, text
        self.t, self.docs = tokens(text, first_line)
        self.pair = pairs(self.t)
        self.units: list[Unit] = []
        self.imports: set[str] = set()
        self.exports: list[tuple[str, str]] = []  # local name, exported name
        self.loose: list[tuple] = []
        self.walk(0, len(self.t), None, self.loose)

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].text in texts and self.t[i].kind != "string"

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name"

    def after(self, i: int) -> int:
        """Index behind the token or bracketed group at i."""
        return self.pair[i] + 1 if self.t[i].text in PAIRS and i in self.pair else i + 1

    def generic(self, i: int) -> int:
        """Behind a list of type parameters that may start at i."""
        if not self.is_(i, "<"):
            return i
        deep = 0
        while i < len(self.t):
            deep += self.is_(i, "<") - self.is_(i, ">")
            i = self.after(i)
            if deep == 0:
                return i
        return i

    def typed(self, i: int, *stops: str) -> int:
        """Behind a type annotation that may start at i with a colon: at the first stop, or where no type goes on."""
        if not self.is_(i, ":"):
            return i
        fresh, i = True, i + 1
        while i < len(self.t):
            if self.is_(i, ";", ",", ")") or (self.is_(i, *stops) and not (fresh and self.is_(i, "{", "("))):
                return i
            fresh = self.is_(i, "|", "&", "<", "=>", ":", "extends", "keyof", "is") and self.t[i].text != "=>"
            i = self.after(i)
        return i

    def ends(self, i: int, hi: int) -> int:
        """End of an expression: a separator, or a new line where neither side asks for more."""
        start = i
        while i < hi and not self.is_(i, ",", ";"):
            if i > start and self.t[i].line > self.t[i - 1].line:
                before, now = self.t[i - 1], self.t[i]
                if (before.kind != "sign" or before.text in (")", "]", "}")) and now.kind != "sign":
                    break
            i = self.after(i)
        return min(i, hi)

    def function_at(self, i: int, hi: int) -> tuple[int, int, int] | None:
        """(first, last, behind) of the body of a function expression or arrow function that starts at i."""
        if self.is_(i, "async") and not self.is_(i + 1, "=>"):
            i += 1
        if self.is_(i, "function"):
            i += 1 + self.is_(i + 1, "*")
            i = self.generic(i + self.named(i))
            if not self.is_(i, "("):
                return None
            i = self.typed(self.after(i), "{")
            return (i + 1, self.pair[i], self.pair[i] + 1) if self.is_(i, "{") else None
        i = self.generic(i)
        if self.is_(i, "("):
            i = self.typed(self.after(i), "=>")
        elif self.named(i):
            i += 1
        if not self.is_(i, "=>") or i >= hi:
            return None
        if self.is_(i + 1, "{"):
            return i + 2, self.pair[i + 1], self.pair[i + 1] + 1
        stop = self.ends(i + 1, hi)
        return i + 1, stop, stop

    def unit(self, kind: str, name: str, start: int, head_end: int, stop: int, owner: str | None, calls: list[tuple], routes=()) -> None:
        a, b = self.t[start], self.t[stop - 1]
        head = SPACE.sub(" ", self.text[a.at : self.t[head_end].at if head_end < len(self.t) else b.end]).strip()
        head = re.sub(r"\s*(?:\{|=>)\s*$", "", head)[:SIGNATURE_CHARS]
        last = b.line + self.text.count("\n", b.at, b.end)
        self.units.append(Unit(self.path, 0, "", kind, f"{owner}.{name}" if owner else name, parent=owner, line_start=a.line, line_end=last, docstring=self.docs.get(start), calls=sorted({n for n, _ in calls if n and not n.startswith("*")}), call_sites=sites(calls), language=self.language, name=name, signature=head, routes=list(routes), uncertainty=dynamic_note(sum(n is None or n.startswith("*") for n, _ in calls))))

    def callable(self, kind: str, name: str, start: int, span: tuple[int, int, int], owner: str | None, routes=()) -> int:
        """A unit of a function whose body is known; what is named inside it comes after it and owns its own calls."""
        lo, hi, behind = span
        calls: list[tuple] = []
        place = len(self.units)
        full = f"{owner}.{name}" if owner else name
        self.walk(lo, hi, full, calls)
        self.unit(kind, name, start, lo, behind, owner, calls, routes)
        self.units.insert(place, self.units.pop())
        return behind

    def value(self, kind: str, name: str, start: int, i: int, hi: int, owner: str | None, calls: list[tuple]) -> int | None:
        """Behind what is bound to a name, where that is a function, a class or an object with methods."""
        if span := self.function_at(i, hi):
            return self.callable(kind, name, start, span, owner)
        if self.is_(i, "class"):
            return self.klass(start, i, hi, owner, name)
        if self.is_(i, "{"):
            full = f"{owner}.{name}" if owner else name
            self.members(i + 1, self.pair[i], full, ":", calls)
            return self.pair[i] + 1
        return None

    def klass(self, start: int, i: int, hi: int, owner: str | None, name: str | None = None) -> int:
        own = self.t[i + 1].text if self.named(i + 1) and not self.is_(i + 1, "extends", "implements") else None
        name, j = name or own or "default", i + 1
        while j < hi and not self.is_(j, "{"):
            j = self.after(j)
        if j >= hi:
            return hi
        stop = self.pair[j] + 1
        self.unit("class", name, start, j, stop, owner, [])
        for k in range(i, j):
            if self.is_(k, "extends") and self.named(k + 1):
                self.units[-1].bases = [self.chain(self.chain_end(k + 1))[0]]
        self.members(j + 1, stop - 1, f"{owner}.{name}" if owner else name, "=", [])
        return stop

    def members(self, i: int, hi: int, owner: str, sign: str, calls: list[tuple]) -> None:
        """Methods of a class body (fields by =) or an object literal (properties by :)."""
        while i < hi:
            start = i
            while self.is_(i, "@"):
                i = self.chain_end(i + 1) + 1
                i = self.after(i) if self.is_(i, "(") else i
            while self.is_(i, *MODIFIERS) and not self.is_(i + 1, "(", "=", ";", ":", ",", "}", "<", "?"):
                i += 1
            if i >= hi:
                return
            key = self.t[i]
            name = key.text.strip("'\"") if key.kind in ("name", "string", "number") else None
            j = self.generic(self.after(i))
            j += self.is_(j, "?", "!")
            if self.is_(j, "(") and (name or self.is_(i, "[")):
                body = self.typed(self.after(j), "{")
                if self.is_(body, "{"):
                    span = (body + 1, self.pair[body], self.pair[body] + 1)
                    i = self.callable("method", name or self.text[key.at : self.t[self.pair[i]].end], start, span, owner)
                    continue
                i = body + 1
                continue
            if sign == "=":
                j = self.typed(j, "=")
            if self.is_(j, sign) and name:
                behind = self.value("method", name, start, j + 1, hi, owner, calls) if not self.is_(j + 1, "{") or sign == ":" else None
                if behind is None:
                    behind = self.ends(j + 1, hi)
                    self.walk(j + 1, behind, None, calls)
            else:
                behind = max(self.ends(i, hi), i + 1)
                self.walk(i, behind, None, calls)
            i = behind + self.is_(behind, ",", ";")

    def chain(self, i: int) -> tuple[str | None, int]:
        """(dotted name, first index) of the names that end at i; an unnamed receiver is a star."""
        names = [self.t[i].text]
        while self.is_(i - 1, "."):
            if self.named(i - 2):
                names.append(self.t[i - 2].text)
                i -= 2
            else:
                return ".".join(["*", *reversed(names)]), i
        return ".".join(reversed(names)), i

    def chain_end(self, i: int) -> int:
        while self.is_(i + 1, ".") and self.named(i + 2):
            i += 2
        return i

    def walk(self, i: int, hi: int, owner: str | None, calls: list[tuple]) -> None:
        """All tokens of a range: declarations become units, other calls go to the list of the unit they stand in."""
        while i < hi:
            t = self.t[i]
            if t.kind != "name" or self.is_(i - 1, "."):
                if t.text == "(" and t.kind == "sign" and i and (self.named(i - 1) or self.is_(i - 1, ")", "]")):
                    i = self.call(i, owner, calls)
                    continue
                i += 1
                continue
            step = self.declaration(i, hi, owner, calls)
            i = step if step is not None else i + 1

    def call(self, i: int, owner: str | None, calls: list[tuple]) -> int:
        """A call whose arguments start at i; the walk goes on inside them unless they are a route's."""
        if not self.named(i - 1):
            calls.append((None, self.t[i].line))
            return i + 1
        name, first = self.chain(i - 1)
        if name in NOT_CALLS:
            return i + 1
        calls.append((name, self.t[first].line))
        args = self.t[i + 1] if i + 1 < self.pair[i] else None
        if name == "require" and args and args.kind == "string":
            self.imports.add(args.text[1:-1])
        last = name.rsplit(".", 1)[-1]
        if "." in name and last in VERBS and args and args.kind == "string" and args.text[0] in "'\"":
            path, at = args.text[1:-1], i + 2
            while at < self.pair[i]:
                span = self.function_at(at, self.pair[i]) if self.is_(at - 1, ",") else None
                if span:
                    return self.callable("function", f"{name}('{path}')", first, span, owner, [f"{last.upper()} {path}"])
                at = self.after(at)
        return i + 1

    def declaration(self, i: int, hi: int, owner: str | None, calls: list[tuple]) -> int | None:
        """Behind the declaration at i; None where there is none that the walk may not enter."""
        start = i
        if self.is_(i, "import") and not self.is_(i + 1, "(", "."):
            return self.import_(i, hi)
        exported = self.is_(i, "export")
        if exported:
            i += 1
            if self.is_(i, "{", "*"):
                return self.export_list(i, hi)
        default = exported and self.is_(i, "default")
        i += default
        while self.is_(i, "async", "declare", "abstract") and self.named(i + 1):
            i += 1
        ts = self.language == "TypeScript"
        give = (lambda local: self.exports.append((local, "default" if default else local))) if exported else (lambda local: None)
        if self.is_(i, "function"):
            j = i + 1 + self.is_(i + 1, "*")
            span = self.function_at(i, hi)
            if span and (self.named(j) or default):
                name = self.t[j].text if self.named(j) else "default"
                give(name)
                return self.callable("function", name, start, span, owner)
            return i + 1 if span else self.ends(i + 1, hi)
        if self.is_(i, "class") and (self.named(i + 1) or default or self.is_(i + 1, "{")):
            give(self.t[i + 1].text if self.named(i + 1) and not self.is_(i + 1, "extends") else "default")
            return self.klass(start, i, hi, owner)
        if self.is_(i, "const", "let", "var") and (not self.is_(i + 1, "enum")):
            return self.bindings(start, i + 1, hi, owner, calls, give)
        i += self.is_(i, "const")
        if ts and self.is_(i, "interface", "enum", "type") and self.named(i + 1) and self.is_(self.generic(i + 2), "{", "=", "extends"):
            j = self.generic(i + 2)
            while j < hi and not self.is_(j, "{", "="):
                j = self.after(j)
            stop = self.after(j) if self.is_(j, "{") else self.ends(j + 1, hi)
            give(self.t[i + 1].text)
            self.unit("type", self.t[i + 1].text, start, j, stop, owner, [])
            return stop
        if ts and self.is_(i, "namespace", "module") and self.named(i + 1):
            end = self.chain_end(i + 1)
            if self.is_(end + 1, "{"):
                name, _ = self.chain(end)
                self.walk(end + 2, self.pair[end + 1], f"{owner}.{name}" if owner else name, calls)
                return self.pair[end + 1] + 1
        if default:
            span = self.function_at(i, hi)
            if span:
                give("default")
                return self.callable("function", "default", start, span, owner)
            if self.named(i) and not self.is_(self.chain_end(i) + 1, "("):
                give(self.t[i].text)
            return i
        return i if exported else self.assignment(i, hi, owner, calls)

    def bindings(self, start: int, i: int, hi: int, owner: str | None, calls: list[tuple], give) -> int:
        while i < hi and (self.named(i) or self.is_(i, "{", "[")):
            name = self.t[i].text if self.named(i) else None
            if name:
                give(name)
            j = self.typed(self.after(i), "=")
            if not self.is_(j, "="):
                return j
            behind = self.value("function", name, start, j + 1, hi, owner, calls) if name else None
            if behind is None:
                behind = self.ends(j + 1, hi)
                self.walk(j + 1, behind, owner, calls)
            if not self.is_(behind, ","):
                return behind
            i = start = behind + 1
        return i

    def assignment(self, i: int, hi: int, owner: str | None, calls: list[tuple]) -> int | None:
        """Functions set on exports or prototypes, and what CommonJS exports."""
        end = self.chain_end(i)
        if not self.is_(end + 1, "=") or end >= hi:
            return None
        parts = self.chain(end)[0].split(".")
        if parts[:2] == ["module", "exports"]:
            parts = ["exports", *parts[2:]]
        value = end + 2
        if parts == ["exports"]:
            if self.is_(value, "{"):
                self.exported(value)
                self.members(value + 1, self.pair[value], "exports", ":", calls)
                for u in self.units:
                    if u.parent == "exports":
                        u.parent, u.qualified_name, u.unit_type = None, u.name, "function"
                return self.pair[value] + 1
            span = self.function_at(value, hi)
            if span:
                named = value + 1 + self.is_(value, "async")
                name = self.t[named].text if self.is_(named - 1, "function") and self.named(named) else "default"
                self.exports.append((name, "default"))
                return self.callable("function", name, i, span, owner)
            if self.is_(value, "class"):
                self.exports.append((self.t[value + 1].text if self.named(value + 1) else "default", "default"))
                return self.klass(i, value, hi, owner)
            if self.named(value):
                self.exports.append((self.t[value].text, "default"))
            return value
        if parts[0] == "exports" and len(parts) == 2:
            self.exports.append((self.t[value].text if self.named(value) and not self.function_at(value, hi) else parts[1], parts[1]))
            return self.value("function", parts[1], i, value, hi, owner, calls) or value
        if "prototype" in parts[1:-1] and (span := self.function_at(value, hi)):
            return self.callable("method", parts[-1], i, span, ".".join(parts[: parts.index("prototype")]))
        return None

    def exported(self, i: int) -> None:
        """Names in an exported object literal: {a, b: c}."""
        j, hi = i + 1, self.pair[i]
        while j < hi:
            if self.named(j):
                local = self.t[j + 2].text if self.is_(j + 1, ":") and self.named(j + 2) and not self.function_at(j + 2, hi) else self.t[j].text
                self.exports.append((local, self.t[j].text))
            j = self.ends(j, hi) + 1

    def export_list(self, i: int, hi: int) -> int:
        """export {a, b as c} [from "x"] and export * from "x"."""
        stop = self.after(i)
        while self.is_(i, "*") and self.is_(stop, "as") and self.named(stop + 1):
            self.exports.append((self.t[stop + 1].text, self.t[stop + 1].text))
            stop += 2
        if self.is_(i, "{"):
            j = i + 1
            while j < stop - 1:
                j += self.is_(j, "type") and self.named(j + 1) and not self.is_(j + 1, "as")
                if self.named(j):
                    renamed = self.is_(j + 1, "as")
                    self.exports.append((self.t[j].text, self.t[j + 2].text if renamed else self.t[j].text))
                    j += 2 * renamed
                j += 1
        if self.is_(stop, "from") and stop + 1 < hi and self.t[stop + 1].kind == "string":
            self.imports.add(self.t[stop + 1].text[1:-1])
            stop += 2
        return stop

    def import_(self, i: int, hi: int) -> int:
        for j in range(i + 1, min(hi, i + 4_000)):
            if self.t[j].kind == "string":
                self.imports.add(self.t[j].text[1:-1])
                return j + 1
            if self.is_(j, ";", "="):
                return j + 1
        return i + 1


def chunks(text: str) -> list[tuple[str, int]]:
    """Parts of a text that start with a declaration at the left margin, each with its first line."""
    cuts = sorted({0, *(m.start() for m in TOP.finditer(text))})
    return [(text[a:b], 1 + text.count("\n", 0, a)) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def analyze(path: str, data: bytes | None, language: str) -> list[Unit]:
    """Units of a file, itself first; a file that can't be read gives one unit with its status."""

    def alone(status, reason):
        return numbered([Unit(path, 0, "", "file", path, name=path.rsplit("/", 1)[-1], language=language, status=status, reason=reason)])

    if data is None:
        return alone("skipped", "unreadable")
    if len(data) > MAX_BYTES:
        return alone("skipped", "too_large")
    if b"\0" in data:
        return alone("skipped", "binary_content")
    if path.endswith((".d.ts", ".d.mts", ".d.cts")):
        return alone("skipped", "declaration_file")
    text = data.decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    status, reason, walks = "ok", None, []
    try:
        walks.append(Walk(path, language, text))
    except Broken as fault:
        status, reason = "partial", f"syntax error near line {fault.args[0]}"
        for part, line in chunks(text):
            try:
                walks.append(Walk(path, language, part, line))
            except (Broken, RecursionError):
                continue
    except RecursionError:
        return alone("failed", "nesting too deep")
    found = [u for w in walks for u in w.units]
    pairs_ = [p for w in walks for p in w.exports]
    needs = sorted({m for w in walks for m in w.imports})
    rows = text.split("\n")
    for u in found:
        u.imports = needs
        u.source = "\n".join(rows[u.line_start - 1 : u.line_end])
        if u.parent is None:
            u.exports = list(dict.fromkeys(out for local, out in pairs_ if local == u.name))
    body, note = clipped(text)
    lines = max(1, text.count("\n") + (not text.endswith("\n")))
    loose = [c for w in walks for c in w.loose]
    head = Unit(path, 0, "", "file", path, line_end=lines, name=path.rsplit("/", 1)[-1], language=language, source=body, imports=needs, exports=sorted({out for _, out in pairs_}), calls=[], uncertainty=note + dynamic_note(sum(n is None or n.startswith("*") for n, _ in loose)), reason=reason, status=status)
    found.sort(key=lambda u: (u.line_start, -u.line_end))
    return numbered([head, *found])
