"""A table of syntax nodes of source files: Python by its own parser, JavaScript, TypeScript, Go and Rust by a scanner with state.

Nodes are numbered in pre-order, and a node knows the last number below it, so a subtree is a range of numbers and every
question about one is a join on ranges (``tessera.operators.syntax``). The scanner knows strings, templates, regular
expressions, comments and brackets: what is quoted or commented gives no node, and a declaration ends where its body or
its statement does.

A file that cannot be read as its language is one row with ``error``, beside the rows of the other files.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import facts

NODES = "file_path string, pre long, last long, parent long, depth int, type string, role string, name string, line int, end_line int, exported boolean, error string"
ARROW = pa.schema([("file_path", pa.string()), *((c, pa.int64()) for c in ("pre", "last", "parent")), ("depth", pa.int32()), *((c, pa.string()) for c in ("type", "role", "name")), ("line", pa.int32()), ("end_line", pa.int32()), ("exported", pa.bool_()), ("error", pa.string())])
#: A node before it is numbered: first and last place, type, role, name, line, end line, exported.
Found = tuple[int, int, str, str | None, str | None, int, int, bool]
#: Rows of one Arrow batch.
BATCH = 4096


def python_nodes(text: str) -> Iterator[tuple]:
    """(pre, last, parent, depth, type, role, name, line, end_line, exported) of every node with a place, in pre-order.

    The name is that of what a node defines, names or calls; the role is the field of the parent that it stands in. A
    context (load, store) is the role of a name that has none of more use: ``target`` where it is written.
    """
    rows: list[list] = []
    todo: list[tuple] = [(ast.parse(text), -1, -1, None)]
    while todo:
        node, parent, depth, role = todo.pop()
        if node is None:  # all below row ``parent`` are numbered
            rows[parent][1] = len(rows) - 1
            continue
        here = parent
        if hasattr(node, "lineno") or isinstance(node, ast.Module):
            here, depth = len(rows), depth + 1
            name = getattr(node, "name", None) or getattr(node, "id", None) or getattr(node, "attr", None) or getattr(node, "arg", None)
            if isinstance(node, ast.Call):
                name = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
            if isinstance(node, ast.Import):
                name = ",".join(a.name for a in node.names)
            if isinstance(node, ast.ImportFrom):
                name = "." * node.level + (node.module or "")
            if isinstance(getattr(node, "ctx", None), ast.Store):
                role = "target"
            first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))]) if hasattr(node, "lineno") else 1
            rows.append([here, here, None if parent < 0 else parent, depth, type(node).__name__, role, name if isinstance(name, str) else None, first, getattr(node, "end_lineno", text.count("\n") + 1), _public(node, name, 0 if parent <= 0 else rows[parent][2], parent)])
            todo.append((None, here, depth, None))
        below = [(child, here, depth, field) for field, value in ast.iter_fields(node) for child in (value if isinstance(value, list) else [value]) if isinstance(child, ast.AST)]
        todo += reversed(below)
    yield from map(tuple, rows)


def _public(node: ast.AST, name: str | None, above: int | None, parent: int) -> bool:
    """Whether a node defines a name of the module that does not begin with an underscore."""
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        return parent == 0 and not node.name.startswith("_")
    return isinstance(getattr(node, "ctx", None), ast.Store) and parent > 0 and above == 0 and isinstance(name, str) and not name.startswith("_")


# What the scanned languages call their declarations, and the kind of node that each makes.
DECLARES = {
    "typescript": {"class": "ClassDeclaration", "interface": "InterfaceDeclaration", "enum": "EnumDeclaration", "type": "TypeAlias", "namespace": "ModuleDeclaration", "function": "FunctionDeclaration", "const": "ConstantDeclaration", "let": "VariableDeclaration", "var": "VariableDeclaration"},
    "go": {"func": "FunctionDeclaration", "type": "TypeAlias", "const": "ConstantDeclaration", "var": "VariableDeclaration", "package": "PackageClause"},
    "rust": {"fn": "FunctionDeclaration", "struct": "StructDeclaration", "enum": "EnumDeclaration", "trait": "TraitDeclaration", "impl": "ImplDeclaration", "mod": "ModuleDeclaration", "const": "ConstantDeclaration", "static": "StaticDeclaration", "type": "TypeAlias", "let": "VariableDeclaration", "macro_rules": "MacroDeclaration"},
}
# Words of the languages that name nothing.
RESERVED = {
    "typescript": "abstract as async await break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in instanceof interface let namespace new null of private protected public readonly return set static super switch this throw true try type typeof undefined var void while yield".split(),
    "go": "break case chan const continue default defer else fallthrough false for func go goto if import interface map nil package range return select struct switch true type var".split(),
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop macro_rules match mod move mut pub ref return self static struct super trait true type unsafe use where while".split(),
}
BODY = {"ClassDeclaration", "InterfaceDeclaration", "EnumDeclaration", "ModuleDeclaration", "FunctionDeclaration", "StructDeclaration", "TraitDeclaration", "ImplDeclaration", "MacroDeclaration", "MethodDefinition"}
CLOSES = {")": "(", "]": "[", "}": "{"}
#: A line end after the first, or before the second, does not end a statement.
GOES_ON, JOINS = set("=+-*/%&|^<>?:.,!~([{"), set("=+-*/%&|^<>?:.,)]}")
TOKENS = {
    "typescript": r"""(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<text>"(?:\\[\s\S]|[^"\\\n])*"?|'(?:\\[\s\S]|[^'\\\n])*'?)|(?P<template>`)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|[=!]==?|[-+*/%&|^<>]=|\?\.|\.\.\.|[\s\S])""",
    "go": r"""(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<text>"(?:\\[\s\S]|[^"\\\n])*"?|'(?:\\[\s\S]|[^'\\\n])*'?|`[^`]*`?)|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>:=|[=!]=|[-+*/%&|^<>]=|[\s\S])""",
    "rust": r"""(?P<skip>\s+|//[^\n]*)|(?P<comment>/\*)|(?P<text>b?r(?P<hash>\#*)"[\s\S]*?(?:"(?P=hash)|\Z)|b?"(?:\\[\s\S]|[^"\\])*"?|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'|'[^\W\d]\w*)|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>=>|->|::|[=!]=|[-+*/%&|^<>]=|[\s\S])""",
}
SCANNERS = {k: re.compile(v) for k, v in TOKENS.items()}
TEMPLATE = re.compile(r"(?:\\[\s\S]|[^`\\$]|\$(?!\{))*")
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
NESTED = re.compile(r"/\*|\*/")
#: Words after which a slash begins a regular expression.
OPENS = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await"}


class Scan:
    """Tokens of a text (kind, text, place) and, for each bracket, the number of the token that matches it."""

    def __init__(self, text: str, language: str):
        scanner, self.kinds, self.words, self.places = SCANNERS[language], [], [], []
        self.match: dict[int, int] = {}
        open_: list[tuple[str, int]] = []
        at = 0
        while at < len(text):
            m = scanner.match(text, at)
            kind, word = m.lastgroup, m[0]
            kind = "text" if kind == "hash" else kind
            if kind == "comment":
                depth, end = 0, at
                for n in NESTED.finditer(text, at):
                    depth += 1 if n[0] == "/*" else -1
                    end = n.end()
                    if not depth:
                        break
                at = end if not depth else len(text)
                continue
            if kind == "mark" and word in "//=" and language == "typescript" and self._operand() is False and (r := REGEX.match(text, at)):
                kind, word = "text", r[0]
            if kind == "mark" and word in CLOSES:
                while open_ and open_[-1][0] not in (CLOSES[word], "`" if word == "}" else ""):
                    open_.pop()  # an opening one without its own
                if open_:
                    what, first = open_.pop()
                    if what == "`":  # back inside the template
                        at = self._template(text, at + 1, open_)
                        continue
                    self.match[first], self.match[len(self.kinds)] = len(self.kinds), first
            elif kind == "mark" and word in "([{":
                open_.append((word, len(self.kinds)))
            if kind == "template":
                self._add("text", "`", at)
                at = self._template(text, at + 1, open_)
                continue
            if kind != "skip":
                self._add(kind, word, at)
            at += len(word)
        ends = [m.start() for m in re.finditer("\n", text)]
        self.lines = [bisect_right(ends, p - 1) + 1 for p in self.places]
        self.ends = [bisect_right(ends, p + len(w) - 2) + 1 if len(w) > 1 else n for p, w, n in zip(self.places, self.words, self.lines, strict=True)]

    def _add(self, kind: str, word: str, at: int) -> None:
        self.kinds.append(kind), self.words.append(word), self.places.append(at)

    def _operand(self) -> bool:
        """Whether the last token ends an operand, so that a slash after it divides."""
        return bool(self.kinds) and (self.kinds[-1] in ("number", "text") or self.words[-1] in (")", "]", "}") or self.kinds[-1] == "word" and self.words[-1] not in OPENS)

    def _template(self, text: str, at: int, open_: list) -> int:
        end = TEMPLATE.match(text, at).end()
        if text.startswith("${", end):
            open_.append(("`", len(self.kinds)))
            return end + 2
        return end + 1


def scanned_nodes(text: str, language: str) -> Iterator[tuple]:
    """The same columns as of ``python_nodes``, for declarations, imports, calls, creations, assignments and identifiers."""
    s = Scan(text, language)
    words, kinds, match, n = s.words, s.kinds, s.match, len(s.words)
    declares, reserved, found = DECLARES[language], set(RESERVED[language]), []
    word = lambda i: words[i] if 0 <= i < n else ""
    name_at = lambda i: 0 <= i < n and kinds[i] == "word" and words[i] not in reserved
    defined: set[int] = set()

    def statement_end(i: int) -> int:
        """The last token of the statement that token i is in."""
        while i + 1 < n:
            i = match[i] if words[i] in ("(", "[", "{") and match.get(i, 0) > i else i
            if i + 1 >= n or words[i] == ";" and kinds[i] == "mark":
                return i
            after = words[i + 1]
            if after in (")", "]", "}") and kinds[i + 1] == "mark":
                return i
            if s.lines[i + 1] > s.ends[i] and language != "rust" and not (kinds[i] == "mark" and words[i][-1] in GOES_ON) and not (kinds[i + 1] == "mark" and after[0] in JOINS):
                return i
            i += 1
        return i

    def body_end(i: int) -> int:
        """The last token of a declaration with a body, i its name: the body's bracket, or the end of a statement that has none."""
        k, angle = i + 1, 0
        while k < n and not (words[k] == ";" and kinds[k] == "mark"):
            angle = max(0, angle + (words[k] == "<") - (words[k] == ">"))
            if (words[k] in ("(", "[") or words[k] == "{" and angle) and kinds[k] == "mark":
                k = match.get(k, n - 1)
            elif words[k] == "{" and kinds[k] == "mark":
                end = match.get(k, n - 1)
                # a type in braces before the body itself
                if word(k - 1) in (":", "|", "&", "->") and word(end + 1) == "{":
                    k = end
                else:
                    return end
            elif language != "rust" and s.lines[k] > s.ends[k - 1] and word(k) in declares:
                return k - 1
            elif word(k) in (")", "}", "]") and kinds[k] == "mark":
                return k - 1
            k += 1
        return min(k, n - 1)

    def add(i: int, end: int, kind: str, name: str | None, role: str | None = None, exported: bool = False) -> None:
        found.append((i, max(i, end), kind, role, name, s.lines[i], s.ends[max(i, end)], exported))

    def before(i: int) -> tuple[int, bool]:
        """First token of a declaration with its modifiers, i its keyword; whether they export it."""
        public = False
        while i > 0 and kinds[i - 1] == "word" and words[i - 1] in ("export", "default", "declare", "abstract", "async", "pub", "unsafe", "extern", "public", "private", "protected", "static", "readonly", "override") or i > 0 and words[i - 1] == ")" and word(match.get(i - 1, 0) - 1) == "pub":
            i = match[i - 1] if words[i - 1] == ")" else i - 1
            public |= words[i] in ("export", "pub")
        return i, public

    def go_group(i: int, kind: str) -> None:
        """The names of a group in brackets: each first word of a line inside it."""
        k, end = i + 1, match.get(i, n - 1)
        while k < end:
            if name_at(k):
                last = min(statement_end(k), end - 1)
                defined.add(k)
                add(k, last, _go_kind(kind, word(k + 1)), words[k], exported=words[k][0].isupper())
                k = last
            k += 1

    i = 0
    while i < n:
        w, plain = words[i], kinds[i] == "word"
        kind = declares.get(w) if plain and word(i - 1) not in (".", "?.") else None
        if plain and w == "import" and language == "typescript" and word(i + 1) not in (".", "("):
            end = statement_end(i)
            add(i, end, "ImportDeclaration", next((words[k][1:-1] for k in range(i, end + 1) if kinds[k] == "text"), None))
        elif plain and w == "export" and language == "typescript":
            made = next((declares[word(k)] for k in range(i + 1, i + 5) if word(k) in declares), None)
            add(i, body_end(i) if made in BODY else statement_end(i), "ExportDeclaration", None)
        elif plain and w == "use" and language == "rust":
            end = statement_end(i)
            add(i, end, "ImportDeclaration", "".join(words[i + 1 : end + (words[end] != ";")]))
        elif plain and w == "import" and language == "go":
            for k in range(i + 1, (match.get(i + 1, i + 1) if word(i + 1) == "(" else statement_end(i)) + 1):
                if kinds[k] == "text":
                    add(k, k, "ImportDeclaration", words[k][1:-1])
        elif kind == "ImplDeclaration":
            k, depth = i + 1, 0
            named = None
            while k < n and words[k] not in ("{", ";", "where"):
                depth += (words[k] == "<") - (words[k] == ">")
                if depth == 0 and name_at(k):
                    named = words[k]
                k += 1
            add(i, body_end(i), kind, named)
        elif kind and language == "go" and word(i + 1) == "(" and w != "func":
            go_group(i + 1, kind)
        elif kind and w != "func" or kind and (name_at(i + 1) or word(i + 1) == "("):
            k = i + 1
            if language == "go" and w == "func" and word(k) == "(":
                k = match.get(k, k) + 1
                kind = "MethodDefinition"
            while word(k) in ("*", "mut", "!", "ref", "fn", "unsafe") or w == "const" and word(k) == "enum":
                k += 1
            if name_at(k) and not (w == "type" and language == "typescript" and word(k + 1) not in ("=", "<")):
                first, public = before(i)
                if language == "go":
                    kind, public = _go_kind(kind, word(k + 1)), words[k][0].isupper()
                defined.add(k)
                add(first, body_end(k) if kind in BODY else statement_end(k), kind, words[k], exported=public)
        elif name_at(i) and language == "typescript" and word(i + 1) == "(" and word(i - 1) not in ("new", ".", "?.", "function"):
            close = match.get(i + 1, i + 1)
            k = close + 1
            if word(k) == ":":
                while k < n and words[k] not in ("{", ";", "=>", ")", ","):
                    k += 1
            if word(k) == "{" and word(i - 1) not in ("=", "(", ",", "return"):
                defined.add(i)
                add(before(i)[0], match.get(k, n - 1), "MethodDefinition", w)
        i += 1
    listed = [(f, e) for f, e, kind, *_ in found if kind == "InterfaceDeclaration"]
    for i in range(n):
        if not name_at(i) or i in defined:
            continue
        if word(i + 1) == "(" and (word(i - 1) in ("{", ";", ",") or s.lines[i] > s.ends[i - 1]) and any(f < i <= e for f, e in listed):
            add(i, statement_end(i), "MethodDefinition", words[i])
            continue
        close = match.get(i + 1, i + 1) if word(i + 1) == "(" else match.get(i + 2, i + 2) if language == "rust" and word(i + 1) == "!" and word(i + 2) in ("(", "[", "{") else 0
        if close:
            add(i - (word(i - 1) == "new"), close, "NewExpression" if word(i - 1) == "new" else "CallExpression", words[i])
        elif word(i + 1) in ("=", ":=") and word(i - 1) != ":" or word(i + 1) in ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="):
            add(i, statement_end(i), "AssignmentExpression", words[i])
        add(i, i, "Identifier", words[i], "callee" if close else "member" if word(i - 1) in (".", "?.") else "target" if word(i + 1) in ("=", ":=") else None)
    yield from _numbered(found, s.ends[-1] if n else 1)


def _go_kind(kind: str, after: str) -> str:
    return {"struct": "StructDeclaration", "interface": "InterfaceDeclaration"}.get(after, kind) if kind == "TypeAlias" else kind


def _numbered(found: list[Found], lines: int) -> Iterator[tuple]:
    """The nodes below one root, numbered in pre-order by their places; of two with one place the longer is above, then the one found first."""
    order = sorted(range(len(found)), key=lambda k: (found[k][0], -found[k][1], k))
    rows = [[0, 0, None, 0, "Program", None, None, 1, lines, False]]
    open_ = [(0, 1 << 62)]
    for k in order:
        first, end, kind, role, name, line, end_line, exported = found[k]
        while open_[-1][1] < first:
            rows[open_.pop()[0]][1] = len(rows) - 1
        rows.append([len(rows), 0, open_[-1][0], len(open_), kind, role, name, line, end_line, exported])
        open_.append((len(rows) - 1, min(end, open_[-1][1])))
    for k, _ in open_:
        rows[k][1] = len(rows) - 1
    yield from map(tuple, rows)


def nodes(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """The nodes of files (path, content) in the languages above, and one row with ``error`` for each file without any.

    Content is text or bytes. Null content is an error, empty content a root alone. A file is read in one piece; its rows leave in batches.
    """
    kind = facts.language(path)

    def of(file: str | None, text: str | bytes | None, language: str | None) -> Iterator[tuple]:
        try:
            if text is None:
                raise ValueError("no content")
            if isinstance(text, bytes):
                text = text.decode()
            if language == "python":
                rows = list(python_nodes(text))
            elif language in ("typescript", "javascript", "go", "rust"):
                rows = list(scanned_nodes(text, "typescript" if language == "javascript" else language))
            else:
                raise ValueError(f"no grammar for {language or 'this extension'}")
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            rows = [(None,) * 10 + (f"{type(e).__name__}: {e}",)]
        for r in rows:
            yield (file, *r) if len(r) == 11 else (file, *r, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held += of(*row)
                while len(held) >= BATCH:
                    yield _batch(held[:BATCH])
                    held = held[BATCH:]
        if held:
            yield _batch(held)

    return files.select(F.col(path).alias("file_path"), content, kind.alias("language")).mapInArrow(run, NODES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
