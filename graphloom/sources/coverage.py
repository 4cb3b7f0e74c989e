"""Coverage reports of three formats as (file, line) tables."""

from __future__ import annotations

import bisect
import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ReportError(ValueError):
    """A report that holds nothing usable; the message says what was expected."""


def _under(root: str, path: str) -> str | None:
    path = path.removeprefix("file://")
    full = os.path.realpath(path if os.path.isabs(path) else os.path.join(root, path))
    top = os.path.realpath(root)
    return os.path.relpath(full, top) if full.startswith(top + os.sep) else None


def istanbul(root: str, report: dict) -> set[tuple[str, int]]:
    """Lines of statements that ran."""
    out = set()
    for name, entry in report.items():
        rel = _under(root, entry.get("path", name)) if isinstance(entry, dict) else None
        for key, at in (entry.get("statementMap") or {}).items() if rel else ():
            if (entry.get("s") or {}).get(key, 0) > 0:
                out |= {(rel, n) for n in range(at["start"]["line"], at["end"]["line"] + 1)}
    if not out:
        raise ReportError("expected an Istanbul report: {file: {statementMap, s}} with executed statements")
    return out


def coverage_py(root: str, report: dict) -> set[tuple[str, int]]:
    return {(rel, n) for name, entry in report["files"].items() if (rel := _under(root, name)) for n in entry.get("executed_lines", ())}


def v8(root: str, reports: Iterable[dict]) -> set[tuple[str, int]]:
    """Byte ranges painted over lines, widest first; inner ranges override."""
    out = set()
    for report in reports:
        for script in report.get("result", ()):
            rel = _under(root, script.get("url", ""))
            if rel is None or "node_modules" in rel or not rel.endswith((".js", ".mjs", ".cjs", ".ts", ".jsx", ".tsx")):
                continue
            with open(os.path.join(root, rel), encoding="utf-8", errors="replace") as f:
                text = f.read()
            starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
            ranges = [r for f in script.get("functions", ()) for r in f.get("ranges", ())]
            ran: dict[int, bool] = {}
            for r in sorted(ranges, key=lambda r: r["startOffset"] - r["endOffset"]):
                first, last = (bisect.bisect_right(starts, r[k] - (k == "endOffset")) for k in ("startOffset", "endOffset"))
                for n in range(first, last + 1):
                    stop = starts[n] - 1 if n < len(starts) else len(text)
                    if r["count"] > 0 or r["startOffset"] <= starts[n - 1] and r["endOffset"] >= stop:
                        ran[n] = r["count"] > 0
            out |= {(rel, n) for n, yes in ran.items() if yes}
    return out


def read_report(root: str, path: str) -> set[tuple[str, int]]:
    """A report file, or a folder of V8 traces; the format is told by its shape."""
    if os.path.isdir(path):
        names = sorted(n for n in os.listdir(path) if n.endswith(".json"))
        return v8(root, (json.load(open(os.path.join(path, n))) for n in names))
    try:
        with open(path) as f:
            report = json.load(f)
    except (OSError, ValueError) as e:
        raise ReportError(f"{path}: {e}") from e
    if isinstance(report, dict) and isinstance(report.get("result"), list):
        return v8(root, [report])
    if isinstance(report, dict) and isinstance(report.get("files"), dict):
        return coverage_py(root, report)
    if not isinstance(report, dict):
        raise ReportError(f"{path}: expected a JSON object")
    return istanbul(root, report)


def read_coverage(spark: SparkSession, root: str, paths: Iterable[str]) -> DataFrame:
    """(file, line) that any of the reports saw run; one project's reports, read on the driver."""
    lines = sorted(set().union(*(read_report(root, p) for p in paths)))
    return spark.createDataFrame(lines, "file string, line int")


ISTANBUL = "map<string, struct<path:string, statementMap:map<string, struct<start:struct<line:int>, end:struct<line:int>>>, s:map<string, int>>>"
COVERAGE_PY = "struct<files:map<string, struct<executed_lines:array<int>>>>"


def report_lines(reports: DataFrame, prefix: str = "") -> DataFrame:
    """(file, line) that any report (content: JSON) saw run, on executors.

    Istanbul and coverage.py reports, told by their shape; paths lose ``prefix``.
    What is neither has no line.
    """
    py = F.get_json_object("content", "$.files").isNotNull()
    plain = lambda p: F.when(F.startswith(p, F.lit(prefix)), F.substring(p, F.lit(len(prefix) + 1), F.length(p))).otherwise(p)
    entries = reports.where(~py).select(F.explode(F.from_json("content", ISTANBUL)).alias("name", "x"))
    ran = entries.select(F.coalesce("x.path", "name").alias("path"), F.col("x.s").alias("s"), F.explode("x.statementMap").alias("k", "at"))
    ran = ran.where(F.coalesce(F.try_element_at("s", "k"), F.lit(0)) > 0)
    first = ran.select(plain(F.col("path")).alias("file"), F.explode(F.sequence("at.start.line", F.greatest("at.start.line", "at.end.line"))).alias("line"))
    files = reports.where(py).select(F.explode(F.from_json("content", COVERAGE_PY)["files"]).alias("path", "x"))
    second = files.select(plain(F.col("path")).alias("file"), F.explode("x.executed_lines").alias("line"))
    return first.unionByName(second).distinct()
