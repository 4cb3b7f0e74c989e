"""Duplicates, contradictions, drift, stubs and concepts on small sources of our own."""

from graphloom.operators import concepts, dupes, settings
from graphloom.plans.staging import Stage
from graphloom.sources import code

FN = "export function {name}(ms: number): string {{\n  const minutes = Math.floor(ms / 60000);\n  const seconds = Math.floor((ms % 60000) / 1000);\n  if (minutes > 0) {{\n    return minutes + 'm ' + seconds + 's';\n  }}\n  return seconds + 's';\n}}\n"
OTHER = "export function parseTable(rows: string[]): string[][] {\n  const out = [];\n  for (const row of rows) {\n    out.push(row.split(','));\n  }\n  return out;\n}\n"
FILES = {
    "src/a.ts": FN.format(name="formatDuration"),
    "src/b.ts": FN.format(name="prettyTime"),
    "src/c.ts": OTHER,
    "src/a.test.ts": FN.format(name="checkDuration"),
    "src/conf1.ts": "export const host = process.env.DB_HOST || 'localhost';\nexport const requestTimeout = 3000;\nexport const nowUtc = () => { return new Date().toISOString(); };\nexport function dayUtc(d: Date) { return d.getUTCDate(); }\n",
    "src/conf2.ts": "export const host = process.env.DB_HOST ?? 'db.internal';\nexport const requestTimeout = 30000;\nexport function day(d: Date) { return d.getDate(); }\nexport function hour(d: Date) { return d.getHours(); }\nexport function later() { throw new Error('not implemented'); }\n",
}


def graph_of(spark, files):
    stage = Stage(spark)
    return code.build(spark.createDataFrame(list(files.items()), "file string, content string"), stage), stage


def test_duplicates(spark):
    g, stage = graph_of(spark, FILES)
    got = dupes.find_duplicates(g, stage).collect()
    assert len(got) == 1 and got[0].members == 2 and got[0].score >= 0.6 and got[0].removable == 8
    more = dupes.find_duplicates(g, stage, include_tests=True).collect()
    assert [r.members for r in more] == [3]


def test_a_parallel_set_is_no_duplicate(spark):
    files = {f"src/locale/{x}.ts": FN.format(name="error") for x in ("de", "en", "es", "fr", "it", "nl")}
    g, stage = graph_of(spark, files)
    got = dupes.find_duplicates(g, stage).collect()
    assert len(got) == 1 and got[0].score < 0.5 and got[0].removable == 0 and "parallel" in got[0].why


def test_contradictions_and_stubs(spark):
    g, _ = graph_of(spark, FILES)
    got = {(r.rule, r.key): r for r in settings.contradictions(g).collect()}
    assert set(got) == {("env-default", "DB_HOST"), ("constant", "request-timeout"), ("time-semantics", "utc/local")}
    assert got["env-default", "DB_HOST"].score >= 0.8 and got["env-default", "DB_HOST"].first_value == "localhost"
    assert [r.name for r in settings.stubs(g).collect()] == ["later"]


def test_drift(spark):
    files = {f"src/f{i}.ts": f"export async function f{i}() {{ const x = await load({i}); return x; }}\n" for i in range(9)}
    files["src/g.ts"] = "export function g() { return load(1).then(show); }\n"
    g, _ = graph_of(spark, files)
    got = {(r.category, r.dialect): r for r in settings.dialect_drift(g).collect()}
    assert got["async", "promise chain"].n == 1 and got["async", "promise chain"].score == 0.8 and got["async", "async/await"].rank == 1


def test_concepts_partition_all_symbols(spark):
    rows = [("r", f"a{i}", i, "a", "loadUser", 10) for i in range(5)] + [("r", f"b{i}", 10 + i, "b", "drawChart", 5) for i in range(5)]
    s = spark.createDataFrame(rows, "repo string, id string, seq long, dir string, name string, loc int")
    e = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(4)] + [(f"b{i}", f"b{i + 1}") for i in range(4)] + [("a0", "b0"), ("a0", "a0")], "src string, dst string")
    stage = Stage(spark)
    exact = concepts.concept_labels(s, e)
    for labels in (exact, concepts.scale_labels(s, e, stage)):
        got = {r.id: r.concept for r in labels.collect()}
        assert set(got) == {r[1] for r in rows}
    named = concepts.describe(exact, s, e).collect()
    assert sum(r.symbols for r in named) == 10 and {r.name for r in named} <= {"a", "b"}
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, concepts.concept_labels(s, e).collect()))


def test_unset_state_and_pages(spark):
    files = {
        "src/view.ts": "let collapsed = false;\nlet seen = 0;\nlet name;\nexport function draw() {\n  seen += 1;\n  if (collapsed) { return seen; }\n  name = 'x';\n  return name ? 1 : 2;\n}\nclass Box {\n  private filterText = '';\n  private count = 0;\n  show() { this.count++; if (this.filterText) { return 1; } return this.count > 0 ? 1 : 2; }\n}\n",
        "page.html": "<html>\n<script src='x.js'></script>\n<script>\nlet searchQuery = '';\nif (searchQuery) { run(); }\n</script>\n<script type='application/json'>{}</script>\n",
        "docs/a.mdx": "import { draw } from '../src/view';\n\n# Title\n",
    }
    g, stage = graph_of(spark, files)
    assert {(r.file, r.line, r.name) for r in settings.unset_state(g).collect()} == {("src/view.ts", 1, "collapsed"), ("src/view.ts", 11, "filterText"), ("page.html", 4, "searchQuery")}
    from graphloom.operators.dead import find_dead

    assert "draw" not in {r.name for r in find_dead(g, stage).collect()}


def test_treemap():
    from graphloom.operators.treemap import squarify

    values = [6, 6, 4, 3, 2, 2, 1, 0]
    boxes = squarify(values, 0, 0, 6, 4)
    for v, (_, _, w, h) in zip(values, boxes, strict=True):
        assert abs(w * h - v) < 1e-9
    assert max(max(w / h, h / w) for _, _, w, h in boxes[:-1]) < 3
    assert squarify([0, 0], 0, 0, 1, 1) == [(0, 0, 0.0, 0.0)] * 2 and squarify([], 0, 0, 1, 1) == []


def test_unset_state_of_long_files_reads_the_text_once():
    """Many variables of one name, and many names of one variable each, in one file."""
    import time

    from graphloom.sources import brace_facts

    same = "".join(f"function f{i}(v) {{\n  let total = {i};\n  total += v;\n  return total;\n}}\n" for i in range(8000))
    own = "".join(f"let s{i} = null;\nfunction g{i}() {{ if (s{i}) return 1; }}\n" + (f"s{i} = 2;\n" if i % 2 else "") for i in range(4000))
    begun = time.process_time()
    got = brace_facts.facts("a.ts", same + own)
    assert time.process_time() - begun < 20
    assert [f[3] for f in got if f[0] == "unset"] == [f"s{i}" for i in range(0, 4000, 2)]
    assert sum(f[0] == "decl" for f in got) == 16_000


def test_edges_are_resolved_when_asked_for(spark):
    from graphloom.plans.staging import Stage
    from graphloom.sources import code

    stage = Stage(spark)
    g = code.build(spark.createDataFrame([("a.ts", "import { f } from './b';\nf();\n"), ("b.ts", "export function f() { return 1; }\n")], "file string, content string"), stage)
    before = stage.count
    assert {r.name for r in g.symbols.collect()} == {"<module>", "f"} and stage.count == before
    assert ("a.ts#<module>", "b.ts#f", "references") in {tuple(r) for r in g.edges.collect()}
    after = stage.count
    assert g.edges.count() and stage.count == after > before
