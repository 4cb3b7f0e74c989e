"""Tools for a writing assistant: questions about one project, answered as plain data.

``Tools`` keeps a scan for some seconds. ``serve`` answers JSON lines of the form
``{"tool": NAME, "args": {...}}`` with ``{"result": ...}`` or ``{"error": TEXT}``.
"""

from __future__ import annotations

import json
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, lookup, project
from graphloom.plans.staging import Stage
from graphloom.sources import stores

NAMES = ("check_before_writing", "find_symbol", "why", "blast_radius", "list_findings", "list_concepts", "load_bearing", "get_intent", "set_intent", "intent_gaps", "read_source")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Tools:
    """The tools of one project; results are small, every one has a limit."""

    def __init__(self, spark: SparkSession, root: str, seconds: float = 30.0):
        self.spark, self.root = spark, root
        self.scan = stores.Cached(lambda: project.scan(spark, root), seconds)

    def _own(self) -> DataFrame:
        return self.scan.get().graph.symbols.where("kind <> 'module'")

    def _intents(self) -> DataFrame:
        rows = [(x["symbol"], x.get("purpose", ""), x.get("status") == "confirmed") for x in stores.intents(self.root).values()]
        return self.spark.createDataFrame(rows, "symbol string, purpose string, confirmed boolean")

    def check_before_writing(self, need: str, limit: int = 5) -> list[dict]:
        """Code that may do already what is about to be written."""
        needs = self.spark.createDataFrame([(0, need)], "need int, text string")
        found = lookup.similar_code(self._own().where(F.col("kind").isin("function", "method", "class")), needs, limit, identifiers=True)
        return _rows(found.join(self._own().select("id", "file", "line"), "id").select("id", "file", "line", "score").orderBy(F.desc("score"), "id"))

    def find_symbol(self, name: str, limit: int = 8) -> list[dict]:
        return _rows(lookup.find_symbol(self._own(), name, limit).join(self._own().select("id", "file", "line", "kind"), "id").orderBy("how", "id"))

    def why(self, symbol: str, limit: int = 60) -> list[dict]:
        return _rows(lookup.why(self._own(), self.scan.get().graph.edges, symbol).orderBy("relation", "id").limit(limit))

    def blast_radius(self, symbol: str, depth: int = 2, limit: int = 60) -> list[dict]:
        return _rows(graph.blast_radius(self.scan.get().graph.edges, symbol, Stage(self.spark), depth).orderBy("hop", "id").limit(limit))

    def list_findings(self, kinds: list[str] | None = None, least: float = 0.0, limit: int = 20) -> list[dict]:
        found = lookup.list_findings(self.scan.get().findings, tuple(kinds or ()), least)
        return _rows(found.orderBy(F.desc(F.col("score") * F.col("loc")), "id").limit(limit))

    def list_concepts(self, limit: int = 30) -> list[dict]:
        return _rows(project.concept_table(self.scan.get(), limit).orderBy(F.desc("loc"), "concept"))

    def load_bearing(self, limit: int = 20) -> list[dict]:
        return _rows(lookup.load_bearing(self._own(), self.scan.get().graph.edges, limit))

    def get_intent(self, words: str, limit: int = 10) -> list[dict]:
        """Purposes written down for a symbol, or that hold the words."""
        exact = stores.intents(self.root).get(words)
        return [exact] if exact else _rows(lookup.intent_search(self._intents(), tuple(words.lower().split()), limit))

    def set_intent(self, symbol: str, purpose: str, confirmed: bool = False, not_for: str = "") -> list[dict]:
        stores.set_intent(self.root, symbol, purpose, confirmed, not_for)
        return [stores.intents(self.root)[symbol]]

    def intent_gaps(self, limit: int = 20) -> list[dict]:
        return _rows(lookup.intent_gaps(self._own(), self.scan.get().graph.edges, self._intents(), limit))

    def read_source(self, path: str, first: int = 1, last: int = 200) -> list[str]:
        return stores.read_lines(self.root, path, first, last)

    def call(self, tool: str, args: dict):
        if tool not in NAMES:
            raise ValueError(f"no tool {tool}; there are {', '.join(NAMES)}")
        return getattr(self, tool)(**args)


def serve(tools: Tools, lines: IO[str], out: IO[str]) -> None:
    """Answer requests until there are no more."""
    for line in lines:
        if not line.strip():
            continue
        try:
            asked = json.loads(line)
            answer = {"result": tools.call(asked["tool"], asked.get("args") or {})}
        except (ValueError, KeyError, TypeError) as e:
            answer = {"error": str(e)}
        out.write(json.dumps(answer, default=str) + "\n")
        out.flush()
