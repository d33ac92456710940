"""Registered queries against their SQL on the small tables, and the guard around the optional subpackage."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(values):
    def plain(x):
        return None if x is None else (round(x, 6) if isinstance(x, float) and not math.isnan(x) else str(x))

    return sorted((tuple(plain(x) for x in r) for r in values), key=repr)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    oracle = entry.oracle_sql().get(name)
    if oracle:
        want = sql.sql(oracle)
        assert sorted(want.columns) == columns
        assert got == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())
    else:
        assert got


def test_entry_without_the_optional_parts(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'quillmesh.llm' or name.startswith('quillmesh.llm.') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
