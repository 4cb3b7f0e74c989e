"""Facts of Python files, by the standard parser, one file at a time on executors."""

from __future__ import annotations

import ast
import io
import re
import textwrap
import tokenize

from graphloom.sources.brace_facts import note_above

STUB = re.compile(r"not[\s_-]*implemented|unimplemented", re.I)
MARK = re.compile(r"\b(TODO|FIXME|XXX)\b")


def uncommented(text: str) -> str:
    """The text without its comments; lines stay. As it is where tokens can't be told."""
    lines = text.splitlines(keepends=True)
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                row, at = t.start
                lines[row - 1] = lines[row - 1][:at] + " " * len(t.string) + lines[row - 1][at + len(t.string) :]
    except (tokenize.TokenError, SyntaxError, IndexError):
        return text
    return "".join(lines)


def facts(path: str, text: str) -> list[tuple]:
    """(table, file, line, a, b, c, d) facts; a file that does not parse gives one ``unparsed`` fact."""
    out: list[tuple] = []
    add = lambda t, line, a="", b="", c="", d="": out.append((t, path, line, a, b, c, d))
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        add("unparsed", 1)
        for i, line in enumerate(text.split("\n"), 1):
            if m := re.match(r"\s*(def|class)\s+(\w+)", line):
                add("decl", i, m[2], "", "class" if m[1] == "class" else "function", str(i))
        return out
    lines = text.split("\n")
    add("text", 1, uncommented(text))

    def body_of(node) -> str:
        inner = node.body
        if inner and isinstance(inner[0], ast.Expr) and isinstance(inner[0].value, ast.Constant) and isinstance(inner[0].value.value, str):
            inner = inner[1:]
        return "\n".join(ast.unparse(x) for x in inner)

    def declare(nodes, container: str) -> None:
        for n in nodes:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "method" if container else "function"
                add("decl", n.lineno, n.name, container, kind, str(n.end_lineno))
                add("body", n.lineno, n.name, container, body_of(n), ast.unparse(n))
                if note := note_above(lines, min([n.lineno, *(d.lineno for d in n.decorator_list)])):
                    add("note", n.lineno, n.name, container, note)
                for d in n.decorator_list:
                    add("decorator", n.lineno, n.name, container, ast.unparse(d.func if isinstance(d, ast.Call) else d))
                stub(n, container)
            elif isinstance(n, ast.ClassDef):
                add("decl", n.lineno, n.name, container, "class", str(n.end_lineno))
                for d in n.decorator_list:
                    add("decorator", n.lineno, n.name, container, ast.unparse(d.func if isinstance(d, ast.Call) else d))
                for b in n.bases:
                    add("heritage", n.lineno, n.name, ast.unparse(b).split(".")[-1], "extends")
                declare(n.body, n.name)
            elif isinstance(n, (ast.If, ast.Try)) and not container:
                declare(n.body, container)
            elif isinstance(n, (ast.Assign, ast.AnnAssign)) and not container:
                targets = n.targets if isinstance(n, ast.Assign) else [n.target]
                for t in targets:
                    if isinstance(t, ast.Name):
                        value = ast.unparse(n.value) if n.value is not None and isinstance(n.value, ast.Constant) else ""
                        add("decl", n.lineno, t.id, "", "variable", str(n.end_lineno))
                        add("constant", n.lineno, t.id, value)

    def stub(n, container: str) -> None:
        if any("abstract" in ast.unparse(d) for d in n.decorator_list):
            return
        inner = [x for x in n.body if not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str))]
        source = "\n".join(lines[n.lineno - 1 : n.end_lineno])
        raises = len(inner) == 1 and isinstance(inner[0], ast.Raise) and inner[0].exc is not None and STUB.search(ast.unparse(inner[0]))
        empty = all(isinstance(x, ast.Pass) or isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and x.value.value is ... for x in inner)
        if raises or empty and MARK.search(source):
            add("stub", n.lineno, n.name, container)

    declare(tree.body, "")
    owner: list[tuple[int, int, str]] = sorted((int(r[2]), int(r[6]), f"{r[4]}.{r[3]}" if r[4] else r[3]) for r in out if r[0] == "decl" and r[5] != "variable")

    def enclosing(line: int) -> str:
        best = ""
        for a, b, name in owner:
            if a <= line <= b:
                best = name
        return best

    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                add("import", n.lineno, a.asname or a.name.split(".")[0], a.name, "module", enclosing(n.lineno))
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                add("import", n.lineno, a.asname or a.name, "." * n.level + (n.module or ""), a.name, enclosing(n.lineno))
        elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
            add("ref", n.lineno, n.id, "", "call" if id(n) in called else "bare", enclosing(n.lineno))
        elif isinstance(n, ast.Attribute) and isinstance(n.ctx, ast.Load):
            base = n.value.id if isinstance(n.value, ast.Name) else ""
            add("ref", n.lineno, n.attr, base or "?", "call" if id(n) in called else "attr", enclosing(n.lineno))
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "getattr" and len(n.args) > 1:
            name = n.args[1]
            if isinstance(name, ast.Constant) and isinstance(name.value, str):
                add("ref", n.lineno, name.value, "?", "attr", enclosing(n.lineno))
            else:
                add("dynamic", n.lineno, "reflection", textwrap.shorten(ast.unparse(n), 120))
        elif isinstance(n, ast.Constant) and isinstance(n.value, str) and n.value.isidentifier():
            add("string", n.lineno, n.value)
        elif isinstance(n, ast.If) and "__name__" in ast.unparse(n.test):
            add("script", n.lineno)
    return out
