"""Every query of the engine against its SQL oracle on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_oracle(name, spark, duck, small):
    df = registry.QUERIES[name](spark, small)
    got = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, got.fetchall())


def test_rows_only(spark, small):
    got = registry.QUERIES["calibrated_threshold"](spark, small).first()
    assert got.candidates == 200 and 0.72 <= got.threshold <= 0.95


def test_entry_is_whole(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 100


def test_without_the_optional_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.split()[1] == "False", out.stderr
