"""Coverage, stores, directives, the scan of a project and the stream that repeats it."""

import json
import subprocess

import pytest

from graphloom import cli
from graphloom.operators import ignores, project
from graphloom.sources import coverage, stores
from graphloom.streaming.watch import watch

CODE = {
    "src/index.ts": "import { used } from './lib';\nused();\n",
    "src/lib.ts": "export function used() { return 1; }\n\n// graphloom-ignore dead: loaded by path\nexport function loaded() { return 2; }\n\n// graphloom-ignore dead\nexport function noReason() { return 3; }\n\n// graphloom-ignore unfinished: wrong kind\nexport function reallyDead() {\n  return 4;\n}\n",
    "jobs/tasks.py": "def hourly():  # graphloom-ignore dead: cron calls it\n    return 1\n\n\ndef export_pdf():\n    raise NotImplementedError\n\n\ndef start():\n    return 2\n\n\nif __name__ == '__main__':\n    start()\n",
    "package.json": "{\"scripts\": {\"start\": \"node src/index.ts\"}}",
}


@pytest.fixture
def tree(tmp_path):
    for k, v in CODE.items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text(v)
    return tmp_path


def test_directives(spark):
    df = spark.createDataFrame(list(CODE.items()), "file string, content string")
    got = {(r.file, r.line): (r.target, r.kinds, r.malformed) for r in ignores.directives(df).collect()}
    assert got == {
        ("src/lib.ts", 3): (4, ["dead"], False), ("src/lib.ts", 6): (7, ["dead"], True), ("src/lib.ts", 9): (10, ["unfinished"], False), ("jobs/tasks.py", 1): (1, ["dead"], False),
    }


def test_scan_check_and_dismiss(spark, tree, capsys):
    root = str(tree)
    s = project.scan(spark, root)
    dead = {r.id.split("#")[-1] for r in s.findings.where("kind = 'dead'").collect()}
    assert dead == {"noReason", "reallyDead", "export_pdf"}
    assert [r.id for r in s.findings.where("kind = 'unfinished'").collect()] == ["unfinished:jobs/tasks.py:export_pdf"]
    used = {(r.file, r.line): r.used for r in s.directives.collect()}
    assert used["src/lib.ts", 3] and used["jobs/tasks.py", 1] and not used["src/lib.ts", 9] and not used["src/lib.ts", 6]
    assert cli.main(["budget", root], spark) == 0 and cli.main(["check", root], spark) == 0
    (tree / "src/more.ts").write_text("export function another() {\n  return 5;\n}\n")
    assert cli.main(["check", root], spark) == 1
    assert cli.main(["dismiss", root, "dead:src/more.ts#another", "on purpose"]) == 0
    assert cli.main(["check", root], spark) == 0
    capsys.readouterr()
    assert cli.main(["scan", root, "--json"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["stats"]["unfinished_count"] == 1 and out["rows"][0]["kind"] == "unfinished"
    for verb in ("concepts", "report", "scan"):
        assert cli.main([verb, root], spark) == 0
    capsys.readouterr()
    assert cli.main(["why", root, "used"], spark) == 0
    assert "src/index.ts#<module>" in capsys.readouterr().out


def test_trend(spark, tree):
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    points = project.trend(spark, str(tree), 3)
    assert len(points) == 1 and points[0]["unfinished_count"] == 1 and 0 <= points[0]["load_bearing"] <= 100
    assert project.trend(spark, str(tree), 3) == points
    assert project.trend(spark, "/tmp", 3) == [] and project.sparkline([1, 1]) == "▄▄" and project.sparkline([0, 1]) == "▁█"


def test_coverage_formats(spark, tree):
    root = str(tree)
    ist = {"x": {"path": f"{root}/src/lib.ts", "statementMap": {"0": {"start": {"line": 4}, "end": {"line": 5}}, "1": {"start": {"line": 9}, "end": {"line": 9}}}, "s": {"0": 2, "1": 0}}}
    (tree / "ist.json").write_text(json.dumps(ist))
    (tree / "py.json").write_text(json.dumps({"files": {"jobs/tasks.py": {"executed_lines": [1, 2]}}}))
    text = CODE["src/index.ts"]
    ranges = [{"startOffset": 0, "endOffset": len(text), "count": 1}, {"startOffset": text.index("used();"), "endOffset": len(text), "count": 0}]
    (tree / "v8").mkdir()
    (tree / "v8/a.json").write_text(json.dumps({"result": [{"url": f"file://{root}/src/index.ts", "functions": [{"ranges": ranges}]}]}))
    got = coverage.read_coverage(spark, root, [f"{root}/ist.json", f"{root}/py.json", f"{root}/v8"])
    assert {tuple(r) for r in got.collect()} == {("src/lib.ts", 4), ("src/lib.ts", 5), ("jobs/tasks.py", 1), ("jobs/tasks.py", 2), ("src/index.ts", 1)}
    (tree / "bad.json").write_text("{}")
    for bad in ("bad.json", "missing.json"):
        with pytest.raises(coverage.ReportError):
            coverage.read_report(root, f"{root}/{bad}")


def test_stores_take_broken_files(tmp_path):
    root = str(tmp_path)
    assert stores.read_budget(root) is None and stores.dismissed(root) == set() and stores.intents(root) == {}
    (tmp_path / ".graphloom").mkdir()
    (tmp_path / ".graphloom/dismissed.json").write_text('{"dismissed": ["old", {"id": "new"}], "fixed": ["gone"]}')
    assert stores.dismissed(root) == {"old", "new", "gone"}
    stores.set_intent(root, "a", "first")
    stores.set_intent(root, "a", "second")
    assert stores.intents(root)["a"]["purpose"] == "second"
    (tmp_path / "package.json").write_text('{"main": "dist/index.js", "bin": {"x": "./dist/cli.js"}}')
    (tmp_path / "src").mkdir()
    for n in ("index.ts", "cli.ts"):
        (tmp_path / "src" / n).write_text("")
    (tmp_path / "graphloom.json").write_text('{"threshold": 0.8, "exclude": ["gen/**"]}')
    c = stores.load_config(root)
    assert (c.entry, c.public, c.threshold, c.exclude) == (("src/cli.ts",), ("src/index.ts",), 0.8, ("gen/**",))


def test_watch_rebuilds(spark, tree, tmp_path_factory):
    seen = []
    check = str(tmp_path_factory.mktemp("check"))
    for n in (1, 2):
        if n == 2:
            (tree / "src/new.ts").write_text("export const x = 1;\n")
        watch(spark, str(tree), lambda files: seen.append(files.count()), check, once=True).awaitTermination()
    assert seen == [3, 4]


def test_look_ups_and_small_stores(spark, tree, capsys):
    root = str(tree)
    for args, want in ((["find", root, "USED"], "src/lib.ts#used"), (["why", root, "use"], "suggestion"), (["uses", root], "["), (["gaps", root], "["), (["ignores", root], "loaded by path"), (["like", root, "hourly"], "[")):
        assert cli.main(args, spark) == 0
        assert want in capsys.readouterr().out
    (tree / "package.json").unlink()
    assert cli.main(["scan", root], spark) == 0
    assert "No entry" in capsys.readouterr().out
    ticks = iter((0.0, 10.0, 31.0))
    made = []
    cached = stores.Cached(lambda: made.append(1) or len(made), 30, lambda: next(ticks))
    assert [cached.get() for _ in range(3)] == [1, 1, 2]
    assert stores.read_lines(root, "src/index.ts", 2, 2) == ["used();"] and stores.read_lines(root, "../x", 1, 2) == []
    git = lambda *a: subprocess.run(["git", "-C", root, *a], check=True, capture_output=True)
    git("init", "-q")
    assert stores.remote_url(root) is None
    git("remote", "add", "origin", "git@example.org:a/b.git")
    assert stores.remote_url(root) == "https://example.org/a/b"


def test_backends_and_the_public_interface(spark):
    import graphloom
    from graphloom.plans.staging import Stage

    def notes(path, text):
        return [("decl", path, i + 1, line.split()[1], "", "function", str(i + 1)) for i, line in enumerate(text.split("\n")) if line.startswith("make ")]

    df = spark.createDataFrame([("a.note", "make tea\nmake toast\n")], "file string, content string")
    g = graphloom.build(df, Stage(spark), backends={".note": notes})
    assert {r.id for r in g.symbols.where("kind = 'function'").collect()} == {"a.note#tea", "a.note#toast"}
    assert all(getattr(graphloom, n) for n in graphloom.__all__)


def test_tools_and_page(spark, tree, capsys):
    import io

    from graphloom.tools import NAMES, Tools, serve

    (tree / "src/lib.ts").write_text(CODE["src/lib.ts"] + "export function formatDuration(ms) {\n  const minutes = ms / 60000;\n  return minutes + 'm';\n}\n")
    asked = [("find_symbol", {"name": "used"}), ("check_before_writing", {"need": "format a duration in minutes"}), ("why", {"symbol": "src/lib.ts#used"}), ("blast_radius", {"symbol": "src/lib.ts#used"}), ("list_findings", {"kinds": ["unfinished"]}), ("load_bearing", {}), ("set_intent", {"symbol": "src/lib.ts#used", "purpose": "is used"}), ("get_intent", {"words": "used"}), ("intent_gaps", {}), ("read_source", {"path": "src/index.ts", "last": 1}), ("nothing", {}), ("why", {"x": 1})]
    out = io.StringIO()
    serve(Tools(spark, str(tree)), [json.dumps({"tool": t, "args": a}) + "\n" for t, a in asked] + ["\n", "{"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got) == len(asked) + 1 and len(NAMES) == 11
    assert got[0]["result"][0]["id"] == "src/lib.ts#used" and got[1]["result"][0]["id"] == "src/lib.ts#formatDuration"
    assert {"relation": "caller", "id": "src/index.ts#<module>"} in got[2]["result"] and got[4]["result"][0]["kind"] == "unfinished"
    assert got[7]["result"][0]["symbol"] == "src/lib.ts#used" and got[9]["result"] == ["import { used } from './lib';"]
    assert all("error" in x for x in got[-3:])
    assert cli.main(["report", str(tree)], spark) == 0
    html = capsys.readouterr().out
    assert html.count("<rect") == 2 and "export_pdf is not implemented" in html
