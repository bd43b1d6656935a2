"""The driver's contract, with and without the parts that can be taken out."""

import importlib
import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"


def test_without_llm(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    e = importlib.import_module("__spark_entry__")
    assert "listing_summary" in e.queries() and not any(n.startswith("op") and n[2:3].isdigit() for n in e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    sys.modules.pop("__spark_entry__", None)


def test_nothing_else_imports_llm():
    out = subprocess.run([sys.executable, "-c", "import sys, pricelattice.plans.queries, pricelattice.streaming.state; print(any('.llm' in m for m in sys.modules))"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.stdout.strip() == "False"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark, tmp_path):
    """A radius reads only its columns, and its box is pushed into the scan."""
    from pricelattice.operators import reads

    spark.createDataFrame([(1, 50.85, 4.35, "x")], "id int, lat double, lng double, other string").write.parquet(str(tmp_path / "p"))
    df = reads.within_radius(spark.read.parquet(str(tmp_path / "p")), 50.85, 4.35, 1.0).select("id", "distance_km")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lat), IsNotNull(lng), GreaterThanOrEqual(lat" in plan and "other" not in plan.split("ReadSchema")[1]
