"""Every query with SQL gives the same rows in Spark and DuckDB."""

import decimal
import os

import pytest

from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

from pricelattice.plans import queries as plans  # noqa: E402
from pricelattice.plans import writes  # noqa: E402, F401


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return float(f"{float(x):.12g}")
    return x


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = con.sql(plans.SQL[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert mine == sorted((tuple(plain(x[k]) for k in at) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["listing_summary", "fresh_nested_listings", "comparison_flag", "fee_delta_rows", "merge_newest_wins", "upsert_preserve", "retention_prune"])
def test_newest_rows_are_hashed(spark, name):
    """The newest capture of each listing combines before the shuffle, without a sort of all captures."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "max_by" in plan and "partial_max_by" in plan


def test_limits_count_what_passed(spark):
    from pricelattice.streaming import state

    e = spark.createDataFrame([(k, "a", f"2026-01-01 00:00:{k:02d}") for k in range(0, 60, 5)] + [(100, "a", "2026-01-01 01:00:05"), (101, None, "2026-01-01 00:00:00"), (102, "a", None)], "id int, k string, at string").withColumn("at", F.to_timestamp("at"))
    got = {r.id: (r.in_window, r.allowed) for r in state.sliding_limit(e, "k", "at", 2, 3600, "id").collect()}
    assert got[0] == (0, True) and got[5] == (1, True) and all(got[k] == (2, False) for k in range(10, 60, 5))
    assert got[100] == (1, True) and got[101] == (0, True) and got[102] == (0, True)


def test_builder_upserts(spark):
    from pricelattice.operators import builder

    t = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id int, x string, y int")
    out = builder.from_table(t).upsert([{"id": 1, "x": {"k": None}, "y": None}, {"id": 3, "x": [1], "y": 2}], "id", ("y",))
    assert sorted(map(tuple, out.collect())) == [(1, '{"k": null}', 5), (2, "b", None), (3, "[1]", 2)]
    with pytest.raises(ValueError):
        builder.from_table(t).update({"x; drop": 1})
