"""Identifier and token functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of prose: letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"
#: Words of identifiers that carry no intent.
STOP = (
    "get", "set", "to", "from", "the", "a", "an", "is", "of", "value", "data",
    "result", "item", "items", "obj", "object", "arg", "args", "opt", "opts",
    "options", "param", "params", "fn", "cb", "callback", "tmp", "temp", "x", "y", "i",
)
#: Shortened words and what they stand for.
SHORT = {
    "ms": "millisecond", "msec": "millisecond", "millis": "millisecond",
    "sec": "second", "secs": "second", "s": "second",
    "min": "minute", "mins": "minute",
    "hr": "hour", "hrs": "hour",
    "ts": "timestamp", "dt": "datetime",
    "num": "number", "cnt": "count", "amt": "amount", "qty": "quantity",
    "str": "string", "bool": "boolean", "int": "integer",
    "msg": "message", "err": "error", "ex": "exception",
    "req": "request", "res": "response", "resp": "response",
    "cfg": "config", "conf": "config", "config": "config", "env": "environment",
    "auth": "authenticate", "usr": "user", "acct": "account", "addr": "address",
    "db": "database", "repo": "repository", "svc": "service", "ctx": "context",
    "init": "initialise", "calc": "calculate", "conv": "convert",
    "fmt": "format", "len": "length", "idx": "index", "buf": "buffer",
    "dir": "directory", "pkg": "package", "dep": "dependency", "util": "utility",
}


def stem(word: Column) -> Column:
    """Expand a short form, drop -ing, -ed or -s, expand again."""
    table = F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])
    expand = lambda w: F.coalesce(F.try_element_at(table, w), w)
    n = F.length(word)
    cut = (
        F.when(word.rlike("ing$") & (n > 5), F.substring(word, F.lit(1), n - 3))
        .when(word.rlike("ed$") & (n > 4), F.substring(word, F.lit(1), n - 2))
        .when(word.rlike("[^s]s$") & (n > 3), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )
    return F.coalesce(F.try_element_at(table, word), expand(cut))


def split_identifier(name: Column) -> Column:
    """Lower-cased, stemmed words of a camel, Pascal, snake or kebab name."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.split(F.lower(spaced), r"[^a-z0-9]+")
    return F.transform(F.filter(words, lambda w: w != ""), stem)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


TOKEN = r"'[^']*'|\"[^\"]*\"|`[^`]*`|[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+(?:\.[0-9]+)?|[^\sA-Za-z0-9_]"


def tokens(code: Column) -> Column:
    """Quoted strings, identifiers, numbers and single marks of code."""
    return F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0))


def shingles(items: Column, n: int) -> Column:
    """The n-grams of an array, space-joined; none if it is shorter."""
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(0), F.size(items) - n), lambda i: F.array_join(F.slice(items, i + 1, n), " "))).otherwise(
        F.array().cast("array<string>")
    )


#: Words that keep their place in the structure of code.
KEYWORDS = (
    "const", "let", "var", "function", "return", "if", "else", "for", "while", "do",
    "switch", "case", "break", "continue", "new", "try", "catch", "finally", "throw",
    "typeof", "instanceof", "async", "await", "yield", "class", "extends", "super",
    "this", "null", "undefined", "true", "false", "in", "of", "delete", "void",
)


def structure(code: Column) -> Column:
    """Token classes: keywords stay, strings S, numbers N, names ID, marks stay."""
    return F.transform(
        tokens(code),
        lambda t: F.when(t.rlike("^['\"`]"), "S").when(t.rlike("^[0-9]"), "N").when(t.isin(*KEYWORDS), t).when(t.rlike("^[A-Za-z_$]"), "ID").otherwise(t),
    )


def glob_regex(glob: str) -> str:
    """A path glob (``**/``, ``**``, ``*``, ``?``, ``{a,b}``, ``[class]``) as an anchored regex."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", r"\\").replace("[", r"\[")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
            continue
        if c == "{":
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in r".+^$()|\{}[]" else c)
        i += 1
    return rf"\A{out}\z"


SCRIPT = r"(?is)<script(?:\s[^>]*)?>(.*?)</script\s*>"


def script_bodies(pages, html: str):
    """The other columns of ``pages`` with (place, body): what stands in the script tags of a page."""
    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.posexplode(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1))).alias("place", "body"))


def round2(x: Column) -> Column:
    """Two decimals, halves of the binary value upwards."""
    return F.floor(x * 100 + 0.5) / 100
