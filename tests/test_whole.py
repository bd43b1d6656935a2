"""Queries do the whole job: against plain versions and brute force; what has SQL is held against that in test_queries."""

import os

import pytest
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

from pricelattice.plans import queries as plans  # noqa: E402


def plain_menus():
    """What menu_pairing gives, item by item: (order, dish, prices) over all lines, an order being a menu."""
    from pricelattice.functions import dims
    from pricelattice.functions.similarity import jaro_winkler

    rows = duckdb.sql(f"SELECT l_orderkey, l_suppkey % 4, l_orderkey * 10 + l_linenumber, p_name, p_retailprice FROM '{SF}/lineitem.parquet' JOIN '{SF}/part.parquet' ON l_partkey = p_partkey ORDER BY 1, 2, 3, 4, 5").fetchall()
    menus: dict = {}
    for order, k, _, title, price in rows:
        key, n, menu = " ".join(sorted(title.lower().split())), 1, menus.setdefault(order, {})
        at = key
        while dims.PLATFORMS[k] in menu.get(at, (None, {}))[1]:
            n += 1
            at = f"{key}::{n}"
        menu.setdefault(at, (title.lower(), {}))[1][dims.PLATFORMS[k]] = int(price / 100 * 100 + 0.5)
    out = []
    for order, menu in menus.items():
        left = [[key, name, prices] for key, (name, prices) in menu.items()]
        while left:
            key, name, prices = left.pop(0)
            for other in list(left):
                x, y = (next(p[c] for c in dims.PLATFORMS if c in p) for p in (prices, other[2]))
                near = min(len(name), len(other[1])) / max(len(name), len(other[1])) >= 0.75 and jaro_winkler(name, other[1]) >= (0.78 if x == y else 0.88)
                if near and not prices.keys() & other[2].keys() and abs(x - y) / max(x, y) <= 0.2:
                    prices |= other[2]
                    left.remove(other)
            out.append((order, key, *(prices.get(c) for c in dims.PLATFORMS)))
    return sorted(out, key=repr)


def test_menus_pair_every_line(spark):
    got = [(r.restaurant_id, r.dish_key, r.uber_eats, r.deliveroo, r.takeaway, r.direct) for r in plans.QUERIES["menu_pairing"](spark, SF).collect()]
    assert sum(x is not None for r in got for x in r[2:]) == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert sorted(got, key=repr) == plain_menus()


def sequential(pairs):
    out, used = [], set()
    for _, a, b in sorted((-t, a, b) for a, b, t in pairs):
        if not {a, b} & used:
            used |= {a, b}
            out.append((a, b))
    return sorted(out)


def test_merges_of_many_copies(spark):
    from pricelattice.operators import resolve

    pairs = [(a, b, 4.0) for a in range(200) for b in range(a + 1, 200)]
    got = resolve.greedy_merges(spark.createDataFrame(pairs, "a int, b int, total double"))
    assert sorted(map(tuple, got.collect())) == sequential(pairs) and len(sequential(pairs)) == 100


def test_merges_by_joins(spark):
    import random

    from pricelattice.operators import resolve

    r = random.Random(1)
    pairs = [(a, b, r.choice([3.5, 4.0])) for a, b in {tuple(sorted(r.sample(range(40), 2))) for _ in range(120)}]
    got = resolve.greedy_merges(spark.createDataFrame(pairs, "a int, b int, total double"), few=0)
    assert sorted(map(tuple, got.collect())) == sequential(pairs)


def test_best_title_is_brute_force(spark):
    import random

    from pyspark.sql import functions as F

    from pricelattice.functions import text
    from pricelattice.functions.similarity import jaro_winkler
    from pricelattice.operators import compare

    r = random.Random(3)
    names = ["pizza quattro formaggi", *{" ".join(r.choice(["pizza", "burger", "tagine", "lasagne", "risotto", "quiche"]) + r.choice(["", "s", "ino"]) for _ in range(r.choice([1, 2, 3]))) for _ in range(80)}]
    wrong = lambda s: "".join(r.choice("xzk") if r.random() < 0.1 or k in (0, len(s) - 1) and r.random() < 0.5 else c for k, c in enumerate(s))
    asked = ["bizza quattro formaggy", "", "zzz", *[wrong(r.choice(names)) for _ in range(200)]]
    items = spark.createDataFrame([(n, k) for k, n in enumerate([*names, *names[:9]])], "name string, position int")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, name string")
    words = {x.name: x.w for x in items.select("name").union(queries.select("name")).withColumn("w", text.title_words(F.col("name"))).collect()}
    want = {}
    for k, n in enumerate(asked):
        found = []
        for at, item in enumerate([*names, *names[:9]]):
            q, t = words[n], words[item]
            sim = jaro_winkler(q, t)
            if q == t or min(len(q), len(t)) / max(len(q), len(t)) >= compare.LENGTHS and sim >= compare.ALIKE:
                found.append((q == t, sim, -at, item))
        if found:
            want[k] = max(found)[3], max(found)[1]
    got = {x.query_id: (x.item, x.sim) for x in compare.best_title(queries, items).collect()}
    assert got == want and want[0][0] == "pizza quattro formaggi"
    one = lambda x: x.withColumn("place", F.lit(1))
    assert {x.query_id: (x.item, x.sim) for x in compare.best_title(one(queries), one(items), "place").collect()} == want


PARTS = [(1, "a", "x", "p", 1), (2, "a", "x", "p", 3), (3, None, "x", "p", 2), (4, "a", "x", None, 2), (5, None, "x", None, None), (6, "b", "x", "q", 2), (6, "b", "x", "q", 7), (7, "b", None, "q", 2), (8, "a", "y", "p", 1), (None, "a", "x", "p", 1), (9, "c", "y", "p", 40), (10, "a", "x", "q", 1)]


def by_sql(name, d):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{d}/part.parquet/*.parquet')")
    r = con.execute(f"SELECT a, b, total, {'decision' if name == 'evidence_bands' else 'NULL'} FROM ({plans.SQL[name]})").fetchall()
    return sorted(r, key=repr)


def test_evidence_of_unknown_values(spark, tmp_path):
    spark.createDataFrame(PARTS, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, plans.QUERIES["evidence_bands"](spark, str(tmp_path)).select("a", "b", "total", "decision").collect()), key=repr)
    assert got == by_sql("evidence_bands", tmp_path) and len(got) == 28


def test_evidence_builds_no_maps(spark):
    """A pair costs a sum of numbers, and a large brand is many cells."""
    plan = plans.QUERIES["evidence_bands"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "map" not in plan and "_i" in plan


def test_evidence_scores_copies_once(spark, tmp_path, monkeypatch):
    """Parts alike but for their ids are scored as one kind; the pairs that come out are still all pairs."""
    from pricelattice.operators import resolve

    p = spark.read.parquet(f"{SF}/part.parquet").where("p_partkey < 60")
    p.crossJoin(spark.range(9).withColumnRenamed("id", "k")).withColumn("p_partkey", F.col("p_partkey") + 1000 * F.pmod(F.col("k") * 7, F.lit(8))).drop("k").write.parquet(f"{tmp_path}/part.parquet")
    features, seen = plans.part_features, []

    def counted(pairs, *more):
        seen.append(pairs.count())
        return features(pairs, *more)

    monkeypatch.setattr(plans, "part_features", counted)
    got = sorted((tuple(r) for r in plans.QUERIES["evidence_bands"](spark, str(tmp_path)).select("a", "b", "total", "decision").collect()), key=repr)
    assert got == by_sql("evidence_bands", tmp_path) and len(got) > 60 * 60
    assert max(seen) <= 60 * 61 / 2
    odd = spark.createDataFrame(PARTS * 3, "id long, p_name string, p_brand string, p_type string, p_size int")
    want = resolve.score(features(resolve.pairs_within(odd, "p_brand"))).select("a", "b", "total", "decision")
    for size, most in ((8_000, 256), (4, 2), (1, 1)):
        made = resolve.score_within(odd, "p_brand", features, size, most)
        assert sorted(map(tuple, made.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_pairs_of_large_blocks(spark):
    from pricelattice.operators import resolve

    rows = [(k, "x" if k % 5 else "y") for k in range(60)] + [(7, "x"), (None, "x"), (60, None), (61, "z")]
    got = resolve.pairs_within(spark.createDataFrame(rows, "id int, g string"), "g", size=9)
    known = [(k, g) for k, g in rows if k is not None and g]
    assert sorted((r.id_a, r.id_b) for r in got.collect()) == sorted((k, m) for k, g in known for m, h in known if g == h and k < m)
    assert got.columns == ["id_a", "g_a", "id_b", "g_b"]


def test_near_misses_make_few_pairs(spark, tmp_path):
    """Copies of parts are one kind: the pairs that are made do not grow with them, and the answer is that over all pairs."""
    from pricelattice.operators import resolve
    from pricelattice.plans import writes  # noqa: F401

    kind = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    spark.createDataFrame(PARTS * 2, kind).write.parquet(f"{tmp_path}/part.parquet")
    got = lambda d: [tuple(r) for r in plans.QUERIES["near_misses"](spark, str(d)).collect()]
    assert got(tmp_path) == sorted((r[:3] for r in by_sql("near_misses", tmp_path)), key=lambda r: (-r[2], *r[:2])) != []
    p = plans.parts_in_brands(spark, SF)
    many = p.where("id < 60").crossJoin(spark.range(30).withColumnRenamed("id", "k")).withColumn("id", F.col("id") + 1000 * F.pmod(F.col("k") * 7, F.lit(30))).drop("k")
    seen = []

    def features(pairs, *more):
        seen.append(pairs.count())
        return plans.part_features(pairs, *more)

    for limit in (1, 7, 200):
        want = resolve.near_misses(resolve.score(plans.part_features(resolve.pairs_within(many, "p_brand"))), limit).select("a", "b", "total")
        assert resolve.near_misses_within(many, "p_brand", features, limit).collect() == want.collect()
    assert max(seen) <= 60 * 61 / 2
