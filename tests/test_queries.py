"""Every query that has SQL agrees with DuckDB on the smallest tables; the entry point works without the corpus operators."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from terrane.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parents[1]


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([cell(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_agrees(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, small)
    cur = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, cur.fetchall())


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_corpus_operators(tmp_path):
    """A copy without the corpus folders still has its other queries."""
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    for f in (ROOT / "terrane").rglob("*.py"):
        if "llm" not in f.parts:
            to = tmp_path / f.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'clean_listings' in q and not any(k.startswith('op') for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True).returncode == 0
