"""Column names that a caller may have chosen: any of them, with dots or clashing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by their exact names."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of ``df`` has, whatever the letters' case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        new, i = f"_{name}", 0
        while new.lower() in taken:
            i += 1
            new = f"_{name}_{i}"
        taken.add(new.lower())
        out.append(new)
    return out
