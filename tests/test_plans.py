"""Every registered query with SQL against DuckDB on the small tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from tracelight import plans

plans.load()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        source = f + "/*.parquet" if os.path.isdir(f) else f
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return str(v)
    return float(f"{v:.8g}") if isinstance(v, float) else v


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df[names].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, con, name):
    got = plans.QUERIES[name](spark, sf)
    assert len(got.columns) == len(set(got.columns))
    if name not in plans.SQL:
        assert name in BY_HAND
        assert BY_HAND[name](spark, sf, [tuple(r) for r in got.collect()])
        return
    a, b = rows(got.toPandas()), rows(con.sql(plans.SQL[name]).df())
    assert a[0] == b[0] and len(a[1]) == len(b[1])
    for x, y in zip(a[1], b[1], strict=True):
        assert x == y


def test_pushdown(spark, sf):
    """Scans read only the columns a query needs."""
    plan = plans.QUERIES["region_scoped_match"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan
    plan = plans.QUERIES["gate_arms"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderpriority:string>" in plan


def test_entry_without_the_llm_part(spark, monkeypatch):
    """The entry point works when the llm subpackage and the pipeline are absent, and passes on what fails inside them."""
    import importlib
    import importlib.util
    import sys

    real = importlib.util.find_spec
    for n in [n for n in sys.modules if n.startswith("tracelight.llm") or n in ("__spark_entry__", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, n)
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("tracelight.llm", "corpus_pipeline") else real(name, *a))
    entry = importlib.import_module("__spark_entry__")
    assert "verdict_summary" in entry.queries() and "pipeline" not in entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    assert entry.entry(spark).count() > 0
    sys.modules.pop("__spark_entry__", None)
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: True if name == "tracelight.llm" else None)
    monkeypatch.setitem(sys.modules, "tracelight.llm", None)
    with pytest.raises(ImportError):
        importlib.import_module("__spark_entry__")
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__", None)
