"""Facts of TypeScript, JavaScript, Go and Swift files, from tokens and brace nesting.

There is no compiler or grammar here: comments and strings are blanked first
(offsets kept), declarations are recognised by their keywords, and their extent
by matching braces. What a name means is left to joins.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from itertools import accumulate

LANGUAGES = {".ts": "ts", ".tsx": "ts", ".js": "ts", ".jsx": "ts", ".mjs": "ts", ".cjs": "ts", ".mts": "ts", ".cts": "ts", ".go": "go", ".swift": "swift"}
STUB = re.compile(r"not[\s_-]*implemented|unimplemented", re.I)
MARK = re.compile(r"\b(TODO|FIXME|XXX)\b")
NAME = re.compile(r"[A-Za-z_$][\w$]*")
#: What stands before the name of something that is only declared to be elsewhere.
AMBIENT = re.compile(r"(?<![\w$.])declare\s+(?:(?:abstract|async|const|let|var|class|function|interface|enum|type)\s+)+\Z")
WORDS = set(
    "if else for while do switch case return break continue function class const let var new typeof instanceof import export from default async await try catch finally throw extends implements interface type enum static public private protected readonly abstract declare get set this super null true false undefined void in of as is "
    "func package struct map range go defer chan select nil string int error bool byte float64 "
    "guard where init deinit override final open internal fileprivate mutating lazy weak self Self extension protocol some any throws rethrows inout".split()
)

_TOP = {
    "ts": [
        (re.compile(r"(?P<x>export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)"), "function"),
        (re.compile(r"(?P<x>export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>[\w$]+)(?:\s*<[^{]*?>)?(?:\s+extends\s+(?P<e>[\w$.]+)[^{]*?)?(?:\s+implements\s+(?P<i>[^{]+))?(?=\s*\{)"), "class"),
        (re.compile(r"(?P<x>export\s+)?(?:declare\s+)?interface\s+(?P<n>[\w$]+)"), "interface"),
        (re.compile(r"(?P<x>export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<n>[\w$]+)"), "enum"),
        (re.compile(r"(?P<x>export\s+)?type\s+(?P<n>[\w$]+)[^=;{}]*="), "type"),
        (re.compile(r"(?P<x>export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=;]+)?=\s*(?P<f>(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^={]+)?=>|(?:async\s+)?function\b)?"), "variable"),
    ],
    "go": [
        (re.compile(r"func\s+\(\s*\w*\s*\*?(?P<c>\w+)[^)]*\)\s*(?P<n>\w+)\s*(?=\()"), "method"),
        (re.compile(r"func\s+(?P<n>\w+)\s*(?=[(\[])"), "function"),
        (re.compile(r"type\s+(?P<n>\w+)\s+struct\b"), "class"),
        (re.compile(r"type\s+(?P<n>\w+)\s+interface\b"), "interface"),
        (re.compile(r"(?:var|const)\s+(?P<n>\w+)\b"), "variable"),
    ],
    "swift": [
        (re.compile(r"(?P<x>(?:public|open)\s+)?(?:final\s+|private\s+|fileprivate\s+|internal\s+)*(?:class|struct|enum|actor)\s+(?P<n>\w+)(?:\s*<[^{]*?>)?(?:\s*:\s*(?P<e>[\w.,\s]+?))?(?=\s*\{)"), "class"),
        (re.compile(r"(?P<x>(?:public|open)\s+)?extension\s+(?P<n>\w+)(?:\s*:\s*(?P<e>[\w.,\s]+?))?(?=\s*\{)"), "extension"),
        (re.compile(r"(?P<x>(?:public|open)\s+)?protocol\s+(?P<n>\w+)"), "interface"),
        (re.compile(r"(?P<x>(?:public|open)\s+)?(?:static\s+|private\s+|fileprivate\s+|internal\s+|mutating\s+|override\s+)*func\s+(?P<n>\w+)"), "function"),
        (re.compile(r"(?P<x>(?:public|open)\s+)?(?:private\s+)?(?:let|var)\s+(?P<n>\w+)\b"), "variable"),
    ],
}
_MEMBER = {
    "ts": re.compile(r"(?:(?:public|private|protected|static|readonly|async|override|get|set)\s+)*(?P<n>#?[\w$]+)\s*(?:<[^>(]*>)?\((?=[^;{}]*\)\s*(?::[^;{}]+)?\{)"),
    "swift": re.compile(r"(?:(?:@\w+|public|open|private|fileprivate|internal|static|class|final|mutating|override)\s+)*func\s+(?P<n>\w+)"),
}


def blank(text: str, lang: str) -> tuple[str, list[tuple[int, str]]]:
    """The text with comments and string contents blanked, and the strings with their offsets."""
    out, strings, i, n = list(text), [], 0, len(text)
    quotes = "\"'`" if lang == "ts" else "\"`" if lang == "go" else '"'
    special = re.compile(rf"//|/\*|[{quotes}]")
    while i < n:
        begin = special.search(text, i)
        if not begin:
            break
        i = begin.start()
        two = text[i : i + 2]
        if two == "//":
            j = text.find("\n", i)
            j = n if j < 0 else j
        elif two == "/*":
            j = text.find("*/", i)
            j = n if j < 0 else j + 2
        else:
            q, j = text[i], i + 1
            while j < n and text[j] != q and (q == "`" or text[j] != "\n"):  # an open string ends with its line
                j += 2 if text[j] == "\\" and q != "`" else 1
            strings.append((i, text[i + 1 : j]))
            if q == "`" and lang == "ts":  # what a template interpolates is code
                j = min(j + 1, n)
                body = text[i:j]
                keep = {i + k for m in re.finditer(r"\$\{([^{}]*)\}", body) for k in range(m.start(1), m.end(1))}
                for k in range(i + 1, j):
                    if k not in keep and text[k] != "\n":
                        out[k] = " "
                i = j
                continue
            for k in range(i + 1, min(j, n)):
                if text[k] != "\n":
                    out[k] = " "
            i = min(j + 1, n)
            continue
        for k in range(i, j):
            if text[k] != "\n":
                out[k] = " "
        i = j
    return "".join(out), [s for s in strings if s[1]]


def uncommented(text: str, code: str, strings: list[tuple[int, str]]) -> str:
    """The text without its comments; strings and lines stay."""
    out = list(code)
    for at, s in strings:
        out[at + 1 : at + 1 + len(s)] = s
    return "".join(out)


#: A comment that names another copy and says why it differs.
INTENDED = re.compile(r"\b(deliberately|intentionally|on purpose|by design|unlike|differs?|different(ly)?)\b", re.I)
SAME = re.compile(r"\b(same|identical|copy|copied|mirrors?|in sync|matches)\b", re.I)


def note_above(lines: list[str], line: int) -> str:
    """The comment right above a line (from 1) that explains a difference; empty without one."""
    said = []
    for i in range(line - 2, max(-1, line - 32), -1):
        text = lines[i].strip()
        if re.match(r"//|/\*|\*|#", text):
            said.append(text)
        elif not text.startswith("@"):
            break
    note = " ".join(said)
    return note if INTENDED.search(note) and not SAME.search(note) else ""


def innermost(owners: list[tuple[int, int, str]]) -> tuple[list[int], list[str]]:
    """Places where the innermost owner changes, and its name from there on."""
    at, names, stack = [0], [""], []

    def leave(until: int) -> None:
        while stack and stack[-1][0] <= until:
            end = stack.pop()[0]
            at.append(end)
            names.append(stack[-1][1] if stack else "")

    for a, b, name in sorted(owners, key=lambda o: (o[0], -o[1])):
        leave(a)
        stack.append((b, name))
        at.append(a)
        names.append(name)
    leave(1 << 60)
    return at, names


def _close(code: str, at: int) -> int:
    """Offset just after the brace that closes the one at or after ``at``; the line's end without one."""
    start, line = code.find("{", at), code.find("\n", at)
    semi = code.find(";", at)
    if start < 0 or 0 <= semi < start:
        return semi + 1 if semi >= 0 else (line if line >= 0 else len(code))
    depth = 0
    for k in range(start, len(code)):
        depth += (code[k] == "{") - (code[k] == "}")
        if not depth:
            return k + 1
    return len(code)


SATELLITES = (".mdx", ".md", ".vue", ".svelte", ".astro", ".html")


def scripts(text: str) -> str:
    """Script bodies of a page or component, everything else blanked, lines kept."""
    keep = [m.span(2) for m in re.finditer(r"(?is)<script([^>]*)>(.*?)</script\s*>", text) if not re.search(r"\bsrc\s*=|type\s*=\s*['\"](?!module|text/(?:java|type)script)", m[1])]
    keep += [m.span(1) for m in re.finditer(r"(?m)^(import\s[^\n]*)", text)]
    keep += [m.span(1) for m in re.finditer(r"(?s)\A---\n(.*?)\n---", text)]
    out = [c if c == "\n" else " " for c in text]
    for a, b in keep:
        out[a:b] = text[a:b]
    return "".join(out)


_DECLARED = re.compile(r"\b(?:let|const|var|function|private)\s+(?=([\w$]+))")
_STOP = re.compile(r"[;\n]")


def _around(code: str, a: int, b: int, use: int, end: int) -> str:
    """What decides on the use of a name from ``use`` to ``end``, code from ``a`` to ``b`` blanked.

    That is all from the last closing bracket before it to the end of its line or statement.
    """
    first = code.rfind(")", 0, use)
    if a <= first < b:
        first = code.rfind(")", 0, a)
    last = end
    while last < len(code) and (code[last].isspace() or a <= last < b):
        last += 1
    stop = _STOP.search(code, last + 1)
    if stop and a <= stop.start() < b:
        stop = _STOP.search(code, b)
    last = max(last + 4, stop.end() if stop else len(code))
    first += 1
    if a < last and first < b:
        return code[first : max(first, a)] + " " * (min(b, last) - max(a, first)) + code[min(b, last) : last]
    return code[first:last]


def _unset(code: str) -> list[tuple[str, int]]:
    """State that conditions read and nothing sets: ``let`` with a fixed or no value, private fields."""
    fixed = r"(?:=\s*(?:null|undefined|true|false|-?[0-9.]+|'\s*'|\"\s*\"|`\s*`|\[\s*\]|\{\s*\})\s*)?;"
    found, declared, places = [], Counter(m[1] for m in _DECLARED.finditer(code)), None
    for pattern, prefix in ((rf"(?<![\w$(])let\s+([\w$]+)\s*(?::[^=;!]+)?{fixed}", ""), (rf"private\s+(?!readonly|static)([\w$]+)\s*(?::[^=;!]+)?{fixed}", r"this\.")):
        for m in re.finditer(pattern, code):
            before = m.start()
            while before and code[before - 1].isspace():
                before -= 1
            if declared[m[1]] != 1 or re.search(r"for\s*\($", code[max(0, before - 12) : before]):
                continue
            if places is None:  # one reading of the file for all names, not one a name
                places = {name: [] for name, n in declared.items() if n == 1}
                for t in re.finditer(r"[\w$]+", code):
                    if t[0] in places:
                        places[t[0]].append(t.start())
            name = re.escape(m[1])
            use = rf"(?<![\w$.]){prefix}{name}(?![\w$])" if not prefix else rf"{prefix}{name}(?![\w$])"
            near = [_around(code, m.start(), m.end(), at, at + len(m[1])) for at in places[m[1]] if not m.start() <= at < m.end()]
            written = rf"{use}\s*(?:=(?![=>])|\+\+|--|[-+*/%|&^]=|(?:\?\?|\|\||&&)=)|(?:\+\+|--)\s*{use}|[\[{{,]\s*{use}\s*[\]}},][^;\n]*=(?!=)"
            asked = rf"(?:if|while)\s*\([^)]*{use}|{use}\s*(?:\?(?![.?:])|&&|\|\|)|!\s*{use}|(?:&&|\|\|)\s*{use}"
            if any(re.search(asked, x) for x in near) and not any(re.search(written, x) for x in near):
                found.append((m[1], m.start()))
    return found


def facts(path: str, text: str) -> list[tuple]:
    """(table, file, line, a, b, c, d) facts of one file."""
    if path.endswith(SATELLITES):
        return [(f[0], path, *f[2:]) for f in facts(f"{path}.ts", scripts(text)) if f[0] in ("import", "ref", "string", "unset")]
    lang = LANGUAGES["." + path.rsplit(".", 1)[-1]]
    if lang == "swift":
        text = re.sub(r"(?m)^[ \t]*#(?:if|elseif|else|endif)[^\n]*", lambda m: " " * len(m[0]), text)
    code, strings = blank(text, lang)
    nl = [m.start() for m in re.finditer("\n", code)]
    line_of = lambda at: bisect.bisect_left(nl, at) + 1
    plain, rows = uncommented(text, code, strings), text.split("\n")
    out: list[tuple] = []
    add = lambda t, at, a="", b="", c="", d="": out.append((t, path, line_of(at), a, b, c, d))
    add("text", 0, plain)
    owners: list[tuple[int, int, str]] = []
    names_at: set[int] = set()

    def declare(at: int, name_at: int, end: int, name: str, container: str, kind: str, exported: bool) -> None:
        add("decl", at, name, container, kind, str(line_of(max(at, end - 1))))
        if exported:
            add("export", at, name, container)
        names_at.add(name_at)
        owners.append((at, end, f"{container}.{name}" if container else name))
        body = code.find("{", name_at)
        whole = text[body + 1 : end - 1] if 0 <= body < end else text[name_at:end]
        add("body", at, name, container, " ".join(plain[body + 1 : end - 1].split() if 0 <= body < end else plain[name_at:end].split()), plain[at:end])
        if note := note_above(rows, line_of(at)):
            add("note", at, name, container, note)
        if kind in ("function", "method"):
            inner = code[body + 1 : end - 1].strip() if 0 <= body < end else ""
            only = re.fullmatch(r"(?:throw\s+new\s+\w+|panic|fatalError|preconditionFailure)\s*\([^;]*\)\s*;?", inner)
            if 0 <= body < end and (only and STUB.search(whole) or not inner and MARK.search(text[body:end])):
                add("stub", at, name, container)

    marks = {m.end(): (m[1], m.start()) for m in re.finditer(r"@([\w.]+)(?:\((?:[^()]|\([^()]*\))*\))?[ \t]*\n?[ \t]*", code)}

    def decorators_before(at: int) -> list[str]:
        """All the decorators that end where a declaration begins, the last first."""
        found = []
        while at in marks:
            name, at = marks[at]
            found.append(name)
        return found

    turns = [(m.start(), 1 if m[0] in "{(" else -1) for m in re.finditer(r"[{}()]", code)]
    turn_at, depths = [at for at, _ in turns], [0, *accumulate(by for _, by in turns)]
    depth_at = lambda at: depths[bisect.bisect_left(turn_at, at)] if at < len(code) else 0
    taken: list[tuple[int, int]] = []
    for pattern, kind in _TOP[lang]:
        for m in pattern.finditer(code):
            at = m.start()
            if depth_at(at) or at and (code[at - 1].isalnum() or code[at - 1] in "_$."):
                continue
            if any(a <= m.start("n") < b for a, b in taken):
                continue
            g = m.groupdict()
            is_function = kind == "variable" and g.get("f")
            end = _close(code, m.end()) if kind != "variable" or is_function else (lambda e: e if e >= 0 else len(code))(code.find("\n", m.end()))
            name = m["n"]
            exported = bool(g.get("x")) if lang != "go" else name[0].isupper()
            container = g.get("c") or ""
            if kind != "extension":
                declare(at, m.start("n"), end, name, container, "function" if is_function else kind, exported)
                if lang == "ts" and AMBIENT.search(code[max(0, at - 40) : m.start("n")]):
                    add("ambient", at, name, container)
            if kind == "variable" and not is_function:
                value = text[m.end() : end].strip().rstrip(";")
                add("constant", at, name, value.lstrip("= ").strip())
            for base in re.findall(r"[\w$]+", " ".join(filter(None, (g.get("e"), g.get("i"))))):
                add("heritage", at, name, base, "extends")
            if kind in ("class", "extension") and lang in _MEMBER:
                taken.append((m.end(), end))
                open_at = code.find("{", m.end() - 1)
                for k in _MEMBER[lang].finditer(code, open_at + 1, end):
                    if depth_at(k.start("n")) == depth_at(open_at) + 1 and k["n"] not in ("if", "for", "while", "switch", "catch", "return"):
                        shown = "private" not in k[0] and not k["n"].startswith("#") if lang == "ts" else bool(re.search(r"\b(public|open)\b", k[0]))
                        declare(k.start(), k.start("n"), _close(code, k.end()), k["n"], name, "method", shown)
                        for a in [*re.findall(r"@(\w+)", k[0]), *decorators_before(k.start())]:
                            add("decorator", k.start(), k["n"], name, a)
            for a in decorators_before(at):
                add("decorator", at, name, container, a)

    changes, inside = innermost(owners)
    enclosing = lambda at: inside[bisect.bisect_right(changes, at) - 1]

    if lang == "ts":
        said = dict(strings)
        for m in re.finditer(r"(import|export)\b([^;'\"`]*?)\bfrom\s*(['\"])|import\s*(['\"])|(?:import|require)\s*\(\s*(['\"`])", code):
            q = m.end() - 1
            spec = said.get(q, "")
            clause = m[2] or ""
            form = "reexport" if m[1] == "export" else "side_effect" if m[4] else "named"
            if m[5]:
                add("import", m.start(), "*", spec, "computed" if "${" in spec else "*", enclosing(m.start()))
                continue
            for a, b in re.findall(r"([\w$*]+)(?:\s+as\s+([\w$]+))?", clause.replace("type ", "")):
                add("import", m.start(), b or a, spec, "*" if a == "*" or "{" not in clause and form == "named" else a, "")
            if not NAME.search(clause) and "*" not in clause:
                add("import", m.start(), "", spec, form, "")
        if re.search(r"(?m)^(?!import|export|function|class|const|let|var|type|interface|enum|async|declare|abstract|@|\}|\)|\s|//)[\w$.]+\s*(?:\(|=[^=>])|^(?:if|for|while|try)\b", code):
            add("side_effects", 0)
    elif lang == "go":
        pkg = re.search(r"(?m)^package\s+(\w+)", code)
        add("package", 0, pkg[1] if pkg else "")
        block = re.search(r"import\s*\(([^)]*)\)", code)
        for o, s in strings:
            if block and block.start() < o < block.end() or re.search(r"import\s+(?:[\w_.]+\s+)?$", code[max(0, o - 30) : o]):
                add("import", o, s.rsplit("/", 1)[-1], s, "module", "")
        for m in re.finditer(r"type\s+\w+\s+interface\s*\{([^}]*)\}", code):
            for k in re.findall(r"(?m)^\s*(\w+)\s*\(", m[1]):
                add("required", m.start(), k)
    elif lang == "swift":
        if re.search(r"@main\b|@UIApplicationMain\b", code):
            add("script", 0)
    for m in NAME.finditer(code):
        name = m[0]
        if name in WORDS or m.start() in names_at:
            continue
        after = code[m.end() : m.end() + 2].lstrip(" ")
        form = "call" if after[:1] == "(" else "bare"
        least = max(0, m.start() - 200)
        last = m.start()
        while last > least and code[last - 1] == " ":
            last -= 1
        dotted = last > least and code[last - 1] == "." and code[max(least, last - 2) : last] != ".."
        base = re.search(r"([\w$]+)\s*[?!]?\.$", code[max(least, last - 60) : last]) if dotted else None
        add("ref", m.start(), name, (base[1] if base else "?") if dotted else "", "call" if form == "call" else "attr" if dotted else "bare", enclosing(m.start()))
    for o, s in strings:
        if s.isidentifier():
            add("string", o, s)
            if code[max(0, o - 80) : o].rstrip().endswith("["):
                add("ref", o, s, "?", "attr", enclosing(o))
    if lang == "ts":
        for name, at in _unset(code):
            add("unset", at, name)
    return out
