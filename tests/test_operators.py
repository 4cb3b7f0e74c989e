"""Unit tests of operators and expressions."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import compare, graph, similar, spans
from graphloom.operators.components import connected_components
from graphloom.plans.staging import Stage


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "name, words",
    [
        ("parseIsoDate", ["parse", "iso", "date"]),
        ("HTTPServer", ["http", "server"]),
        ("snake_case_name", ["snake", "case", "name"]),
        ("kebab-case", ["kebab", "case"]),
        ("fmtMsgs", ["format", "message"]),
        ("loadedItems", ["load", "item"]),
        ("class", ["class"]),
        ("", []),
    ],
)
def test_split_identifier(spark, name, words):
    got = value(spark, T.split_identifier(F.lit(name)))
    assert got == words


@pytest.mark.parametrize(
    "glob, path, want",
    [
        ("**/*.ts", "a/b/c.ts", True), ("**/*.ts", "c.ts", True), ("*.ts", "a/c.ts", False), ("src/**", "src/a/b", True),
        ("src/{a,b}/*.py", "src/b/x.py", True), ("src/{a,b}/*.py", "src/c/x.py", False), ("?.go", "a.go", True), ("[ab].go", "b.go", True),
        ("[!ab].go", "b.go", False), ("a.b", "axb", False), ("**/test_*.py", "x/y/test_a.py", True), ("a.ts", "a.ts\n", False),
    ],
)
def test_glob(spark, glob, path, want):
    assert value(spark, F.lit(path).rlike(T.glob_regex(glob))) is want


def test_structure_and_shingles(spark):
    code = "const x = 'a' + 12; if (x) { return x }"
    got = value(spark, T.structure(F.lit(code)))
    assert got[:6] == ["const", "ID", "=", "S", "+", "N"] and "if" in got
    assert value(spark, T.shingles(F.split(F.lit("a b c d"), " "), 3)) == ["a b c", "b c d"]
    assert value(spark, T.shingles(F.split(F.lit("a b"), " "), 3)) == []


def test_round_of_the_binary_value(spark):
    assert value(spark, T.round2(F.lit(0.285))) == 0.28


def brute_components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"), Stage(spark)).collect()
    want = {k: v for k, v in brute_components([x for x in links if x[0] != x[1]]).items()}
    assert {x.node: x.root for x in got} == want and len(got) == len(want)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), Stage(spark)).count() == 0
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"), Stage(spark)).count() == 0


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("a", "b"), (None, "q")]


def test_reachable_and_unreached(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    roots = spark.createDataFrame([("a",)], "id string")
    seen = {r.id for r in graph.reachable(e, roots, Stage(spark)).collect()}
    assert seen == set("abcd")
    every = spark.createDataFrame([(c,) for c in "abcdxy"], "id string")
    left = {r.id for r in graph.unreached(every, e, roots, Stage(spark)).collect()}
    assert left == set("xy") and seen | left == set("abcdxy")


def test_blast_radius(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    assert {(r.id, r.hop) for r in graph.blast_radius(e, "d", Stage(spark), 9).collect()} == {("c", 1), ("b", 2), ("a", 3)}


def test_ignores_shrink_groups(spark):
    f = spark.createDataFrame(
        [("g", "duplicate", "m1", "f1", 3), ("g", "duplicate", "m2", "f2", 4), ("g", "duplicate", "m3", "f3", 5), ("h", "duplicate", "m4", "f1", 3), ("h", "duplicate", "m5", "f2", 3), ("d", "dead", "m6", "f1", 9)],
        "id string, kind string, member string, file string, loc int",
    )
    d = spark.createDataFrame([("f1", "duplicate"), ("f1", "dead")], "file string, kind string")
    assert {(r.id, r.members, r.loc) for r in compare.apply_ignores(f, d).collect()} == {("g", 2, 9)}


def test_ratchet_fails_on_growth_only(spark):
    one = lambda **k: spark.range(1).select(*[F.lit(k.get(m)).cast("long").alias(m) for m in compare.METRICS])
    now = one(dead_loc=5, duplicate_loc=1, drift_count=0, contradiction_count=2, unfinished_count=7)
    got = {r.metric: r.failed for r in compare.ratchet(now, one(dead_loc=4, duplicate_loc=2, drift_count=0, contradiction_count=2)).collect()}
    assert got == {"dead_loc": True, "duplicate_loc": False, "drift_count": False, "contradiction_count": False, "unfinished_count": False}


def test_innermost_range(spark):
    r = spark.createDataFrame([("f", 1, 1, 100), ("f", 2, 5, 50), ("f", 3, 5, 60), ("g", 4, 1, 9)], "file string, seq long, line long, end_line long")
    s = spark.createDataFrame([("f", 7, 1), ("f", 80, 2), ("f", 101, 3), ("g", 5, 4)], "file string, line long, site long")
    assert {(x.site, x.seq) for x in spans.innermost(r, s).collect()} == {(1, 2), (2, 1), (4, 4)}


def test_executed_and_paint(spark):
    r = spark.createDataFrame([("f", 1, 1, 3), ("f", 2, 4, 6)], "file string, seq long, line long, end_line long")
    assert [x.seq for x in spans.executed(r, spark.createDataFrame([("f", 5), ("f", 6)], "file string, line long")).collect()] == [2]
    lines = spark.createDataFrame([("f", 1, 0, 9), ("f", 2, 10, 19)], "file string, line long, line_start long, line_stop long")
    p = spark.createDataFrame([("f", 0, 30, True, 1), ("f", 10, 19, False, 2), ("f", 3, 5, False, 3)], "file string, start long, stop long, hit boolean, seq long")
    assert {(x.line, x.executed) for x in spans.paint(lines, p).collect()} == {(1, True), (2, False)}


def test_calibration():
    assert similar.calibrated_threshold([], 0.72) == 0.72
    assert similar.calibrated_threshold([0.9] * 100, 0.72) == 0.95
    assert similar.random_pairs(100) == similar.random_pairs(100) and all(a != b for a, b in similar.random_pairs(5))


def test_same_result_with_other_partitions(spark, small):
    from graphloom.plans import registry

    one = sorted(map(tuple, registry.QUERIES["dup_components"](spark, small).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert sorted(map(tuple, registry.QUERIES["dup_components"](spark, small).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_few_files_and_names_of_any_form(spark):
    from pyspark.sql import functions as F

    from graphloom.plans.columns import fresh, quoted
    from graphloom.plans.staging import Stage, few_files, input_bytes

    wide = spark.range(0, 1000, 1, 64)
    assert few_files(wide).rdd.getNumPartitions() == 8 and input_bytes(wide) > 0
    stage = Stage(spark)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    cut = stage.cut(wide.groupBy((F.col("id") % 7).alias("k")).count())
    assert {r["count"] for r in cut.collect()} == {142, 143} and spark.conf.get(name) == before
    odd = spark.range(1).select(F.lit(1).alias("a.b"), F.lit(2).alias("_x"), F.lit(3).alias("c`d"))
    assert fresh(odd, "x", "x", "y") == ["_x_1", "_x_2", "_y"]
    assert odd.select(*quoted(odd.columns)).columns == odd.columns


def test_report_pieces(spark):
    from graphloom.operators import report

    files = spark.createDataFrame([("a", "one\ntwo\nthree"), ("b", "")], "file string, content string")
    spans = spark.createDataFrame([(1, "a", 2, 2), (2, "a", 3, 9), (3, "b", 1, 1), (4, "gone", 1, 1)], "id int, file string, line int, end_line int")
    got = {r.id: (r.first, r.text) for r in report.snippets(files, spans, 1).collect()}
    assert got == {1: (1, "one\ntwo\nthree"), 2: (2, "two\nthree"), 3: (1, "")}
    assert report.lines_of(files).count() == 4
    marks = report.line_marks(spark.createDataFrame([("a", 2, "dead", 2), ("a", 3, "drift", 0)], "file string, line int, kind string, loc int"))
    assert {(r.line, tuple(r.marks)) for r in marks.collect()} == {(2, ("dead",)), (3, ("dead", "drift"))}


def test_similar_pairs_of_blocks_lose_no_pair(spark, small):
    """The pairs that blocks find are those of the joins, whatever the size of a block."""
    from graphloom.plans.staging import Stage
    from graphloom.sources import tables

    sym = tables.symbols(spark, small)
    extra = spark.createDataFrame([("x#1", -1, None), ("x#2", -2, ""), ("x#3", -3, "! ?"), ("x#4", -4, "rareword zweites"), ("x#5", -5, "Rareword ZWEITES"), ("x#6", -6, "rareword zweites"), ("x#7", -7, "erstword one"), ("x#7", -8, "erstword two"), ("x#8", -9, "erstword one two erstword")], "id string, seq long, body string")
    sym = sym.select("id", "seq", "body").unionByName(extra)
    bag = similar.bags(sym)
    want = sorted(map(tuple, similar.cosine(bag, similar.candidate_pairs(sym, bag), 0.9).collect()))
    assert ("x#6", "x#4", 1.0) in [(a, b, round(s, 9)) for a, b, s in want]
    for block in (100_000, 400):
        assert sorted(map(tuple, similar.similar_pairs(sym, 0.9, Stage(spark), block=block).collect())) == want
