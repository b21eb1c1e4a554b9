"""Registered queries against their SQL, and what is left without the corpus subpackage."""

import importlib
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from mixfield.plans import registry

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    return str(v)


@pytest.mark.parametrize("name", [n for n in registry.ORACLE if not n.startswith("gap_")])
def test_query_equals_sql(spark, con, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.sql(registry.ORACLE[name])
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    rows = sorted(repr([norm(r[c]) for c in columns]) for r in got.collect())
    assert rows == sorted(repr([norm(r[i]) for i in order]) for r in want.fetchall())


@pytest.mark.parametrize("name", ["noise_injection", "init_density", "forward_backward"])
def test_other_queries_give_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["id", "x", "y", "rho", "delta"] and found.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_corpus_subpackage(tmp_path):
    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('mixfield.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert 'density_peaks' in e.queries() and not any(k.startswith('op') for k in e.queries()) and e.oracle_sql()\n"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, check=True, timeout=120)
    assert importlib.util.find_spec("mixfield")
