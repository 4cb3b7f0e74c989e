"""A code base, or a corpus, as tables: analyses as Spark plans.

The names below are the public interface; they are imported when first asked for.
"""

from importlib import import_module

#: Public names and the modules they live in.
_PUBLIC = {
    "scan": "graphloom.operators.project",
    "worklist": "graphloom.operators.project",
    "concept_table": "graphloom.operators.project",
    "check_budget": "graphloom.operators.project",
    "trend": "graphloom.operators.project",
    "build": "graphloom.sources.code",
    "load_config": "graphloom.sources.stores",
    "read_coverage": "graphloom.sources.coverage",
    "find_dead": "graphloom.operators.dead",
    "Rule": "graphloom.operators.dead",
    "find_duplicates": "graphloom.operators.dupes",
    "contradictions": "graphloom.operators.settings",
    "Divergence": "graphloom.operators.settings",
    "dialect_drift": "graphloom.operators.settings",
    "blast_radius": "graphloom.operators.graph",
    "reachable": "graphloom.operators.graph",
    "find_symbol": "graphloom.operators.lookup",
    "similar_code": "graphloom.operators.lookup",
    "load_bearing": "graphloom.operators.lookup",
    "list_findings": "graphloom.operators.lookup",
    "intent_gaps": "graphloom.operators.lookup",
    "why": "graphloom.operators.lookup",
    "watch": "graphloom.streaming.watch",
    "Stage": "graphloom.plans.staging",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name in _PUBLIC:
        return getattr(import_module(_PUBLIC[name]), name)
    raise AttributeError(name)
