"""From a folder of source files to the graph tables: facts on executors, meaning by joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import glob_regex

FACT = "tab string, file string, line int, a string, b string, c string, d string, seq long"
#: Facts that are handed on together, and tasks that the files are dealt to.
FACT_ROWS, FACT_TASKS = 50_000, 64
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js", ".py", "/__init__.py")
INCLUDE = ("**/*.{ts,tsx,js,jsx,mjs,cjs,mts,cts,py,go,swift,mdx,md,vue,svelte,astro,html}",)
EXCLUDE = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/vendor/**", "**/__pycache__/**", "**/.*/**", ".*/**", "**/*.d.ts")


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE) -> DataFrame:
    """(file, content) of a folder tree, globs as predicates on the path under ``root``."""
    base = root.rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    name = F.substring(path, F.lit(len(base) + 2), F.length(path)).alias("file")
    hit = lambda globs: F.rlike("file", F.lit("|".join(map(glob_regex, globs))))
    # names alone first, so that nothing reads the bytes of what the globs leave out
    wanted = [r.path for r in read.load(base).select("path", name).where(hit(include) & ~hit(exclude)).select("path").collect()]
    if not wanted:
        return spark.createDataFrame([], "file string, content string")
    return read.load(wanted).select(name, F.decode("content", "UTF-8").alias("content"))


#: What reads the facts of a file, by its ending: (path, text) to rows of ``FACT`` without the last column.
Backend = Callable[[str, str], list[tuple]]


def default_backends() -> dict[str, Backend]:
    """Backends by file ending; the empty one takes all other files."""
    from graphloom.sources import brace_facts, python_facts

    return {".py": python_facts.facts, "": brace_facts.facts}


def facts(files: DataFrame, backends: dict[str, Backend] | None = None) -> DataFrame:
    """The fact table of (file, content); one row a declaration, reference, import, ...

    ``backends`` are further ones, or others for known endings; they run on executors.
    """
    own = dict(backends or {})

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {**default_backends(), **own}
        rows: list[tuple] = []
        for batch in batches:
            for file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                make = known[max((e for e in known if file.endswith(e)), key=len)]
                rows += [(*f, i) for i, f in enumerate(make(file, content or ""))]
                if len(rows) >= FACT_ROWS:  # the facts of a batch of long files are never held whole
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    # a file is read as a whole, so that long ones are dealt one by one
    return files.select("file", "content").repartition(FACT_TASKS).mapInArrow(extract, FACT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``FACT``."""
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    fields = [c.split() for c in FACT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(values, types[t]) for values, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[name for name, _ in fields])


def _lang(file: Column) -> Column:
    return F.when(file.endswith(".py"), "py").when(file.endswith(".go"), "go").when(file.endswith(".swift"), "swift").otherwise("ts")


def _dir(file: Column) -> Column:
    return F.regexp_replace(file, "/?[^/]*$", "")


@dataclass
class Graph:
    symbols: DataFrame
    resolve: Callable[[], DataFrame]
    facts: DataFrame
    #: (file, lines): how many lines each file has.
    lengths: DataFrame

    @cached_property
    def edges(self) -> DataFrame:
        """Resolved when first asked for: much is said of symbols alone."""
        return self.resolve()


def _meant(spec: Column, aliases: list[tuple[str, str]]) -> Column:
    """A specifier with the longest alias it begins with replaced by what that means."""
    out = spec
    for prefix, folder in reversed(aliases):  # longest first, so the longest is asked first
        rest = F.substring(spec, F.lit(len(prefix) + 1), F.length(spec))
        whole = F.concat(F.lit(folder), F.when((rest != "") & ~rest.startswith("/") & F.lit(folder != "") & F.lit(not folder.endswith("/")), F.concat(F.lit("/"), rest)).otherwise(rest))
        fits = spec.startswith(prefix) if prefix.endswith("/") else (spec == prefix) | spec.startswith(f"{prefix}/")
        out = F.when(fits, whole).otherwise(out)
    return out


def build(files: DataFrame, stage, aliases: list[tuple[str, str]] = (), backends: dict[str, Backend] | None = None) -> Graph:
    """Symbols and edges of (file, content).

    ``aliases``: (prefix, folder) that specifiers begin with, see ``stores.aliases``.
    """
    f = stage.cut(facts(files, backends).withColumn("lang", _lang(F.col("file"))))
    of, sid = lambda tab: f.where(F.col("tab") == tab), _sid
    full = F.when(F.col("b") == "", F.col("a")).otherwise(F.concat_ws(".", "b", "a"))
    first = Window.partitionBy("id").orderBy("seq")
    exported = of("export").select("file", F.col("a").alias("name"), F.col("b").alias("container"), F.lit(True).alias("x")).distinct()
    decl = of("decl").select(
        sid(F.col("file"), full).alias("id"), "file", "lang", "seq", F.col("a").alias("name"), F.col("b").alias("container"), F.col("c").alias("kind"), "line", F.col("d").cast("int").alias("end_line")
    )
    decl = decl.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r").join(exported, ["file", "name", "container"], "left")
    body = of("body").select(sid(F.col("file"), full).alias("id"), "seq", F.struct(F.col("c").alias("body"), F.col("d").alias("source")).alias("x"))
    body = body.groupBy("id").agg(F.min_by("x", "seq").alias("x")).select("id", "x.*")
    shown = F.when(F.col("lang") == "py", ~F.col("name").startswith("_")).otherwise(F.coalesce("x", F.lit(False)))
    symbols = decl.join(body, "id", "left").select(
        "id", "file", "lang", "seq", "name", "container", "kind", "line", "end_line", (F.col("end_line") - F.col("line") + 1).alias("loc"), shown.alias("exported"), F.coalesce("body", F.lit("")).alias("body"), F.coalesce("source", F.lit("")).alias("source")
    )
    modules = files.select("file").withColumn("lang", _lang(F.col("file"))).select(
        sid(F.col("file"), F.lit("")).alias("id"), "file", "lang", F.lit(-1).cast("long").alias("seq"), F.lit("<module>").alias("name"), F.lit("").alias("container"),
        F.lit("module").alias("kind"), F.lit(0).alias("line"), F.lit(0).alias("end_line"), F.lit(0).alias("loc"), F.lit(False).alias("exported"), F.lit("").alias("body"), F.lit("").alias("source"),
    )
    symbols = stage.cut(symbols.unionByName(modules))
    lengths = files.select("file", F.size(F.split(F.coalesce("content", F.lit("")), "\n")).alias("lines"))
    return Graph(symbols, lambda: _edges(files, f, symbols, stage, aliases), f, lengths)


def _sid(file: Column, name: Column) -> Column:
    return F.concat(file, F.lit("#"), F.when(name == "", "<module>").otherwise(name))


def _edges(files: DataFrame, f: DataFrame, symbols: DataFrame, stage, aliases: list[tuple[str, str]]) -> DataFrame:
    """(src, dst, kind): what the facts refer to, by joins with the symbols."""
    of, sid = lambda tab: f.where(F.col("tab") == tab), _sid
    names = symbols.where("kind <> 'module'").select("id", "file", "lang", "name", "container", "kind", _dir(F.col("file")).alias("dir"))

    # imports: every path that a specifier may mean, in order of preference, joined to the files there are
    imports = of("import").select("file", "lang", "seq", F.col("a").alias("alias"), F.col("b").alias("spec"), F.col("c").alias("what"), F.col("d").alias("owner"))
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    dotted = F.regexp_replace(F.regexp_replace("spec", r"^\.+", ""), r"\.", "/")
    up = F.array_join(F.slice(F.split(_dir(F.col("file")), "/"), 1, F.greatest(F.size(F.split(_dir(F.col("file")), "/")) - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")
    py = F.when(dots > 0, F.concat_ws("/", F.when(up != "", up), F.when(dotted != "", dotted))).otherwise(dotted)
    joined = F.concat_ws("/", F.when(_dir(F.col("file")) != "", _dir(F.col("file"))), F.col("spec"))
    target = F.when(F.col("lang") == "py", py).when(F.col("spec").startswith("."), joined).otherwise(_meant(F.col("spec"), list(aliases)))
    target = F.regexp_replace(target, r"(^|/)\./", "$1")
    for _ in range(6):
        target = F.regexp_replace(target, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    target = F.regexp_replace(target, r"\.js$", "")
    bases = F.array(F.concat_ws("/", target, F.when(F.col("lang") == "py", F.col("what"))), target)  # a submodule before the package
    tried = imports.select("*", F.posexplode(F.flatten(F.transform(bases, lambda t: F.array(*[F.concat(t, F.lit(s)) for s in SUFFIXES])))).alias("rank", "path"))
    known = files.select(F.col("file").alias("path"), F.col("file").alias("to"))
    found = tried.join(known, "path").groupBy("file", "lang", "seq", "alias", "spec", "what", "owner").agg(F.min_by("to", "rank").alias("to"))
    go = imports.where("lang = 'go'").join(names.where("lang = 'go'").select("dir", F.col("file").alias("to")).distinct(), F.expr("endswith(spec, dir) and dir <> ''")).select("file", "lang", "seq", "alias", "spec", "what", "owner", "to")
    found = stage.cut(found.where("lang <> 'go'").unionByName(go))
    # a computed path reaches every file that its fixed beginning starts, and what these export
    start = F.regexp_extract("to_path", r"^([^$]*)", 1)
    computed = imports.where("what = 'computed'").select("file", "owner", target.alias("to_path")).withColumn("start", start).where("start like '%/%'")
    computed = computed.join(known.select("to"), F.expr("startswith(to, start)")).select(sid(F.col("file"), F.col("owner")).alias("src"), "to")
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))
    edges = edge(found, sid(F.col("file"), F.col("owner")), sid(F.col("to"), F.lit("")), "imports")

    edges = edges.unionByName(edge(computed, F.col("src"), sid(F.col("to"), F.lit("")), "imports"))
    shown_there = symbols.where("exported and container = ''").select(F.col("file").alias("to"), "id")
    edges = edges.unionByName(edge(computed.join(shown_there, "to"), F.col("src"), F.col("id"), "references"))

    refs = of("ref").select("file", "lang", F.col("a").alias("name"), F.col("b").alias("base"), sid(F.col("file"), F.col("d")).alias("src"), F.col("c").alias("form"), F.col("d").alias("owner")).distinct()
    top = names.where("container = ''")
    own = refs.where("base = ''").join(top.select("file", "name", "id"), ["file", "name"])
    via = found.select("file", F.col("alias").alias("name"), "what", "to")
    target = top.select(F.col("file").alias("to"), F.col("name").alias("what"), "id")
    named = refs.where("base = ''").join(via, ["file", "name"]).join(target, ["to", "what"])
    reexport = found.where("what not in ('*', 'module')").join(target, ["to", "what"]).select(sid(F.col("file"), F.lit("")).alias("src"), "id")
    star = found.select("file", F.col("alias").alias("base"), "to").distinct()
    spaced = refs.where("base <> ''").join(star, ["file", "base"]).join(top.select(F.col("file").alias("to"), "name", "id"), ["to", "name"])
    members = names.where("container <> ''").select("lang", "name", "id")
    loose = refs.where("base <> ''").join(members, ["lang", "name"])
    package = names.where("lang in ('go', 'swift')")
    near = refs.where("lang = 'go' and base = ''").withColumn("dir", _dir(F.col("file"))).join(package.where("lang = 'go' and container = ''").select("dir", "name", "id"), ["dir", "name"])
    world = refs.where("lang = 'swift'").join(package.where("lang = 'swift'").select("lang", "name", "id"), ["lang", "name"])
    for part in (own, named, spaced, loose, near, world):
        edges = edges.unionByName(edge(part, F.col("src"), F.col("id"), "references"))
    edges = edges.unionByName(edge(reexport, F.col("src"), F.col("id"), "imports"))
    # a class reaches its constructor and protocol members; overriding members follow the base's
    special = names.where("container <> '' and (name in ('constructor', 'toString', 'toJSON', 'init') or name rlike '^__.*__$')")
    holder = top.select("file", F.col("name").alias("container"), F.col("id").alias("cls"))
    edges = edges.unionByName(edge(special.join(holder, ["file", "container"]), F.col("cls"), F.col("id"), "references"))
    heirs = of("heritage").select("lang", F.col("a").alias("derived"), F.col("b").alias("parent")).distinct()
    inherited = names.where("container <> ''").select("lang", F.col("container").alias("derived"), "name", F.col("id").alias("dst"))
    parents = names.where("container <> ''").select("lang", F.col("container").alias("parent"), "name", F.col("id").alias("src"))
    edges = edges.unionByName(heirs.join(inherited, ["lang", "derived"]).join(parents, ["lang", "parent", "name"]).select("src", "dst", F.lit("implements").alias("kind")))
    # a base that is not in the code may call any member of the class
    outside = heirs.join(top.select("lang", F.col("name").alias("parent")).distinct(), ["lang", "parent"], "left_anti")
    cls = top.select("lang", F.col("name").alias("derived"), F.col("id").alias("src"))
    edges = edges.unionByName(outside.select("lang", "derived").distinct().join(cls, ["lang", "derived"]).join(inherited.where("lang <> 'swift'"), ["lang", "derived"]).select("src", "dst", F.lit("implements").alias("kind")))
    required = of("required").select("lang", F.col("a").alias("name")).distinct().join(names.where("container <> ''").select("lang", "name", "container", F.col("id").alias("dst")), ["lang", "name"])
    types = top.select("lang", F.col("name").alias("container"), F.col("id").alias("src"))
    edges = edges.unionByName(required.join(types, ["lang", "container"]).select("src", "dst", F.lit("implements").alias("kind")))
    # a package's own __init__ runs when one of its modules is imported
    inits = files.where("file like '%/__init__.py'").select(_dir(F.col("file")).alias("dir"), sid(F.col("file"), F.lit("")).alias("dst"))
    below = files.where("file like '%.py'").select(sid(F.col("file"), F.lit("")).alias("src"), F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda i: F.array_join(F.slice(F.split("file", "/"), 1, i), "/"))).alias("dir"))
    edges = edges.unionByName(below.join(inits, "dir").select("src", "dst", F.lit("imports").alias("kind")))
    return stage.cut(edges.where("src <> dst"))


DATA = ("**/*.{json,yml,yaml,toml,ini,cfg,xml,properties,plist,storyboard,xib}",)
LOCKS = ("**/{package-lock.json,pnpm-lock.yaml,yarn.lock,composer.lock,coverage-final.json}", "**/tsconfig*.json")
#: Fixed value: larger data files name nothing.
MAX_DATA_BYTES = 256 << 10


def data_names(files: DataFrame) -> DataFrame:
    """(name, file): names in data files that code may be called by; the first file of a name.

    ``files``: (file, content). A name has four characters or more and a capital
    or underscore after the first.
    """
    small = files.where((F.octet_length("content") <= MAX_DATA_BYTES) & F.col("file").rlike("|".join(map(glob_regex, DATA))) & ~F.col("file").rlike("|".join(map(glob_regex, LOCKS))))
    names = small.select("file", F.explode(F.regexp_extract_all("content", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]{3,}"), F.lit(0))).alias("name"))
    return names.where(F.substring("name", F.lit(2), F.length("name")).rlike("[A-Z_]")).groupBy("name").agg(F.min("file").alias("file"))
