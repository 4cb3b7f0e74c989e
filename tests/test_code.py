"""Source files to findings, on small repositories of our own."""

import pytest

from graphloom.operators.dead import active_rules, find_dead, findings, has_entry
from graphloom.plans.staging import Stage
from graphloom.sources import brace_facts, code, python_facts, stores

PY = {
    "app/main.py": "from .helpers import format_duration\nfrom . import store\n\nclass Job:\n    def run(self):\n        return self.step()\n    def step(self):\n        return format_duration(3)\n    def unused_method(self):\n        return 1\n\nif __name__ == '__main__':\n    Job().run()\n    store.save(1)\n",
    "app/__init__.py": "",
    "app/helpers.py": "def format_duration(s):\n    m = s // 60\n    return f'{m}m'\n\ndef pretty_time(s):\n    m = s // 60\n    return f'{m}m'\n",
    "app/store.py": "def save(x):\n    return x\n\ndef never_called_anywhere():\n    return 2\n",
}
TS = {
    "src/index.ts": "import { formatDuration, fetchUser } from './util';\nimport * as clock from './clock';\nexport function main() {\n  // unusedLegacyFormatter\n  return formatDuration(3) + clock.now() + fetchUser('a');\n}\nmain();\n",
    "src/util.ts": "export function formatDuration(ms: number): string {\n  const m = `${pad(ms)}`;\n  return m;\n}\nfunction pad(n: number) { return '0' + n; }\nexport function unusedLegacyFormatter(ms: number) {\n  return ms / 1000;\n}\nexport const fetchUser = async (id: string) => {\n  return fetch('/u/' + id);\n};\nexport const fetchAccount = async (id: string) => {\n  return fetch('/a/' + id);\n};\n",
    "src/clock/index.ts": "export const now = () => Date.now();\nexport class Wheel {\n  turn() { return this.grip(); }\n  private grip() { return 1; }\n  idle() { return 2; }\n}\nexport const wheel = new Wheel();\n",
}
GO = {
    "go.mod": "module example.com/x\n",
    "cmd/main.go": "package main\n\nimport \"example.com/x/internal/work\"\n\nfunc main() {\n\twork.Start()\n}\n\nfunc unusedInMain() int { return 1 }\n",
    "internal/work/a.go": "package work\n\ntype runner interface {\n\tRun()\n}\n\ntype job struct{}\n\nfunc (j job) Run() { helper() }\n\nfunc Start() { start(job{}) }\n\nfunc start(r runner) { r.Run() }\n\nfunc Forgotten() {}\n",
    "internal/work/b.go": "package work\n\nfunc helper() { }\n\nfunc notImplemented() { panic(\"not implemented\") }\n",
    "pub/p.go": "package pub\n\nfunc Public() {}\n\nfunc private() {}\n",
}
SWIFT = {
    "App/Main.swift": "@main\nstruct App {\n  static func main() { Screen().show() }\n}\n#if DEBUG\nfunc leftover() { }\n#endif\nclass Screen {\n  func show() { draw() }\n  func draw() { print(\"\\(1)\") }\n  func purge() { }\n}\n",
}


def graph_of(spark, files):
    rows = spark.createDataFrame([(k, v) for k, v in files.items() if not k.endswith(".mod")], "file string, content string")
    stage = Stage(spark)
    return code.build(rows, stage), stage


def names(df):
    return sorted(r.name for r in df.collect())


def test_python(spark):
    g, stage = graph_of(spark, PY)
    assert names(find_dead(g, stage)) == ["never_called_anywhere", "pretty_time", "unused_method"]


def test_typescript(spark):
    g, stage = graph_of(spark, TS)
    dead = find_dead(g, stage)
    assert names(dead.where("kind <> 'class'")) == ["fetchAccount", "grip", "idle", "turn", "unusedLegacyFormatter", "wheel"]
    score = {r.name: r.score for r in dead.collect()}
    assert score["grip"] > score["unusedLegacyFormatter"]


def test_coverage_keeps_what_ran(spark):
    g, stage = graph_of(spark, TS)
    ran = spark.createDataFrame([("src/util.ts", 7)], "file string, line int")
    dead = {r.name: r.score for r in find_dead(g, stage, coverage=ran).collect()}
    assert "unusedLegacyFormatter" not in dead and dead["fetchAccount"] == 0.97


def test_entry_and_public_globs(spark):
    g, stage = graph_of(spark, TS)
    assert "wheel" not in names(find_dead(g, stage, public=("src/clock/**",)))
    assert names(find_dead(g, stage, entry=("src/**",))) == []


def test_go(spark):
    g, stage = graph_of(spark, GO)
    assert names(find_dead(g, stage)) == ["Forgotten", "notImplemented", "private", "unusedInMain"]
    assert [r.a for r in g.facts.where("tab = 'stub'").collect()] == ["notImplemented"]


def test_swift(spark):
    g, stage = graph_of(spark, SWIFT)
    assert names(find_dead(g, stage)) == ["leftover", "purge"]


def test_scan_reads_a_tree(spark, tmp_path):
    for k, v in {**TS, "node_modules/x/a.ts": "x", ".hidden/b.ts": "x", "readme.md": "x"}.items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text(v)
    got = {r.file: r.content for r in code.scan(spark, str(tmp_path)).collect()}
    assert got == {**TS, "readme.md": "x"}


@pytest.mark.parametrize("text", ["", "def f(:\n", "class A(B): pass\n", "x = 'open", "\0"])
def test_python_facts_never_fail(text):
    assert isinstance(python_facts.facts("a.py", text), list)


@pytest.mark.parametrize("text", ["", "const a = 'open\nfunction f() {", "}}}}", "`${a", "/* never closed", "class A { b() { c(", "export default function() {}"])
def test_brace_facts_never_fail(text):
    for name in ("a.ts", "a.go", "a.swift"):
        assert isinstance(brace_facts.facts(name, text), list)


def test_computed_imports_and_names_in_data(spark):
    files = {
        "src/index.ts": "export async function load(x: string) { return import(`./locale/${x}`); }\nload('de');\n",
        "src/locale/de.ts": "export const hello = () => 'hallo';\nconst hidden = () => 1;\n",
        "src/jobs.ts": "export class NightlyJob {\n  run() { return 1; }\n}\n",
    }
    g, stage = graph_of(spark, files)
    data = code.data_names(spark.createDataFrame([("b.yml", "job: NightlyJob"), ("a.yml", "x: NightlyJob plain"), ("package-lock.json", "OtherName")], "file string, content string"))
    assert [tuple(r) for r in data.collect()] == [("NightlyJob", "a.yml")]
    got = {r.name: r.score for r in find_dead(g, stage, data_names=data).collect()}
    assert set(got) == {"hidden", "NightlyJob", "run"} and got["NightlyJob"] <= 0.45 < got["hidden"]


def test_no_entry_says_nothing(spark):
    files = {"src/a.ts": "export function one() {\n  return 1;\n}\n"}
    g, stage = graph_of(spark, files)
    df = spark.createDataFrame(list(files.items()), "file string, content string")
    assert findings(g, stage, df).count() == 0 and not has_entry(df, ("src/main.ts",), ())
    assert [r.id for r in findings(g, stage, df, entry=("src/a.ts", "x")).collect()] == []
    assert findings(g, stage, df, entry=("other.ts",)).count() == 0


def test_orphan_files_doubt_and_rules(spark):
    files = {
        "src/main.ts": "import { go } from './lib';\ngo();\n",
        "src/lib.ts": "export function go() { return 1; }\nexport function alone() {\n  return 2;\n}\n",
        "src/old.ts": "export function left() {\n  return right();\n}\nfunction right() {\n  return 3;\n}\n",
        "src/named.ts": "export class NightlyJob extends Base {\n  run() { return 1; }\n}\nclass Base {\n  help() { return 2; }\n}\nexport function sure() {\n  return 4;\n}\n",
        "src/cats.ts": "@Controller('cats')\nexport class Cats {\n  @Get()\n  list() { return listed(); }\n}\nfunction listed() { return 5; }\n",
        "src/api.ts": "export class Shown {\n  open() { return 1; }\n  _own() { return 2; }\n}\n",
    }
    g, stage = graph_of(spark, files)
    df = spark.createDataFrame(list(files.items()), "file string, content string")
    data = spark.createDataFrame([("NightlyJob", "jobs.yml")], "name string, file string")
    args = dict(entry=("src/main.ts",), public=("src/api.ts",), data_names=data)
    got = {r.id: r for r in findings(g, stage, df, **args, rules=active_rules({"@nestjs/core"})).collect()}
    assert {i for i in got if i.startswith("orphan")} == {"orphan-file:src/old.ts"} and got["orphan-file:src/old.ts"].loc == 7
    names_of = {i.split("#")[-1]: r for i, r in got.items()}
    assert {"alone", "NightlyJob", "NightlyJob.run", "sure"} <= set(names_of) and not {"left", "Cats", "Cats.list", "listed", "Shown.open"} & set(names_of)
    assert names_of["NightlyJob"].score <= 0.45 and "by name" in names_of["Base"].title and names_of["sure"].score >= 0.6
    off = {r.id for r in findings(g, stage, df, **args, rules=active_rules(set())).collect()}
    assert "orphan-file:src/cats.ts" in off


def test_aliases_and_manifests(spark, tmp_path):
    made = {
        "tsconfig.json": '{\n  // paths\n  "compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["src/lib/*"]},},\n}',
        "package.json": '{"workspaces": ["packages/*"], "dependencies": {"React": "1"}, "imports": {"#tools/*": "./src/tools/*"}}',
        "packages/core/package.json": '{"name": "@x/core", "main": "src/index.ts", "devDependencies": {"next": "1"}}',
        "packages/core/src/index.ts": "export function core() { return 1; }\n",
        "go.mod": "module example.com/x\n",
        "pyproject.toml": '[project]\nname = "p"\ndependencies = ["Flask>=2", "celery[redis]"]\n[project.scripts]\nrun = "app.cli:main"\n',
        "app/cli.py": "def main():\n    return 1\n",
        "wrangler.toml": 'main = "src/worker.ts"\n',
        "src/worker.ts": "import { a } from '@lib/a';\nimport { t } from '#tools/t';\nimport { core } from '@x/core';\nexport default { fetch() { return a() + t() + core(); } };\n",
        "src/lib/a.ts": "export function a() { return 1; }\n",
        "src/tools/t.ts": "export function t() { return 1; }\n",
    }
    for k, v in made.items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text(v)
    root = str(tmp_path)
    c = stores.load_config(root)
    assert {"react", "next", "flask", "celery"} <= c.dependencies and set(c.entry) >= {"src/worker.ts", "app/cli.py"} and c.public == ("packages/core/src/index.ts",)
    assert {r.name for r in active_rules(c.dependencies)} == {"react", "next", "flask", "celery"}
    files = {k: v for k, v in made.items() if k.endswith((".ts", ".py"))}
    stage = Stage(spark)
    g = code.build(spark.createDataFrame(list(files.items()), "file string, content string"), stage, stores.aliases(root))
    links = {(r.src, r.dst) for r in g.edges.where("kind = 'imports'").collect()}
    assert {("src/worker.ts#<module>", f"{f}#<module>") for f in ("src/lib/a.ts", "src/tools/t.ts", "packages/core/src/index.ts")} <= links
