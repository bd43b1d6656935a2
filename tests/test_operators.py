"""Cases worked out by hand for what the queries do not show."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricelattice.functions import geo, hours, similarity, text
from pricelattice.operators import builder, compare, mutate, rank, resolve
from pricelattice.plans import cases
from pricelattice.sources import payloads
from pricelattice.streaming import state


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("2x Margherita", "Margherita", True), ("52. Malay Soup", "Malay Soup", True), ("Sparkling Water 330 ml", "Sparkling Water", True), ("Crème Brûlée", "creme brulee", True), ("7up", "up", False), ("Margherita 30cm", "Margherita", False), ("Small Fries", "Large Fries", False), ("Fries (large)", "Fries", True), ("(only)", "only", True)],
)
def test_titles(spark, a, b, same):
    assert (one(spark, text.title_key, a) == one(spark, text.title_key, b)) == same


def test_title_category(spark):
    df = spark.createDataFrame([("Pizza Margherita", "Pizza"), ("Pizza", "Pizza"), ("Margherita", None)], "t string, c string")
    assert [r.k for r in df.select(text.title_key(F.col("t"), F.col("c")).alias("k")).collect()] == ["margherita", "pizza", "margherita"]


@pytest.mark.parametrize(("value", "want"), [("€ 12,50", 12.5), ("10", 10.0), ("gratuit", 0.0), ("freekick 3", 3.0), ("€0,00", 0.0), ("none", None), (None, None)])
def test_price(spark, value, want):
    assert one(spark, text.menu_price, value) == want


def test_ratings(spark):
    assert one(spark, text.rating, "4,7") == 4.7
    assert one(spark, lambda c: text.rating(c, comma=False), "4,7") == 4.0


@pytest.mark.parametrize(("raw", "want"), [("02 555 11 22", "+3225551122"), ("+32 2 555 11 22", "+3225551122"), ("0032 475 12 34 56", "+32475123456"), ("12", None), (None, None)])
def test_phones(spark, raw, want):
    assert one(spark, text.phone_e164, raw) == want


def test_jaro_winkler():
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert similarity.jaro_winkler("", "x") == 0.0
    assert similarity.jaro_winkler("abcd", "abxy", 0.7) == similarity.jaro("abcd", "abxy")
    assert similarity.jaro_winkler("abcd", "abxy") > similarity.jaro("abcd", "abxy")
    assert similarity.indel_ratio("abc", "abd") == pytest.approx(66.6667, abs=1e-3)


def test_hours_text(spark):
    got = one(spark, hours.schema_text, "Mo-We 11:00-22:00, Su 9:00-12:00")
    assert [(r.day, r.open, r.close) for r in got] == [("mon", "11:00", "22:00"), ("tue", "11:00", "22:00"), ("wed", "11:00", "22:00"), ("sun", "09:00", "12:00")]


def test_rounding(spark):
    assert [one(spark, geo.half_up, v, "double") for v in (2.5, -2.5, 0.5)] == [3, -2, 1]
    assert [one(spark, geo.half_even, v, "double") for v in (2.5, 3.5)] == [2.0, 4.0]


def test_cells_cut_toward_zero(spark):
    assert [one(spark, geo.cell, v, "double") for v in (-0.001, 0.001, 0.0016)] == [0, 0, 1]


def decisions(spark):
    rows = resolve.prepare(spark.createDataFrame(cases.MERCHANTS, cases.MERCHANT_SCHEMA))
    return {(r.a, r.b): r for r in resolve.score(resolve.features(resolve.block(rows), rows)).collect()}


def test_matcher(spark):
    got = decisions(spark)
    assert got["a1", "a2"].decision == "auto_merge"
    assert got["d1", "d2"].decision == "queue"  # one kitchen, two brands
    assert got["c1", "c2"].decision == "separate"  # branches far apart
    assert all(p not in got or got[p].decision != "auto_merge" for p in [("a1", "b1"), ("a2", "b1")])


def test_matcher_symmetric(spark):
    rows = resolve.prepare(spark.createDataFrame(cases.MERCHANTS, cases.MERCHANT_SCHEMA))
    pairs = resolve.block(rows)
    there, back = resolve.features(pairs, rows), resolve.features(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), rows)
    key = lambda f, x, y: {(r[x], r[y]): r for r in resolve.score(f).select("a", "b", "total", "decision").collect()}
    a, b = key(there, "a", "b"), key(back, "b", "a")
    assert {k: (round(r.total, 9), r.decision) for k, r in a.items()} == {k: (round(r.total, 9), r.decision) for k, r in b.items()}


def test_greedy_merges(spark):
    pairs = spark.createDataFrame([("a", "b", 5.0), ("b", "c", 6.0), ("c", "d", 4.0), ("x", "y", 4.0)], "a string, b string, total double")
    assert sorted(map(tuple, resolve.greedy_merges(pairs).collect())) == [("b", "c"), ("x", "y")]


def test_presence(spark):
    got = {r.search_id: r for r in resolve.presence(spark.createDataFrame(cases.SEARCHES, cases.SEARCH_SCHEMA)).collect()}
    assert {k: r.outcome for k, r in got.items()} == {0: "uncertain", 1: "absent", 2: "present", 3: "present", 4: "uncertain", 5: "uncertain", 6: "present", 7: "present"}
    assert got[3].matched_url == "u3" and got[4].block_reason == "colocated_no_corroboration" and got[5].block_reason == "proximity_only" and got[0].block_reason == "blocked"


def test_contacts(spark):
    c = spark.createDataFrame([(1, "osm", "+321", "direct"), (1, "fsq", "+322", "unknown"), (1, "website", "+321", "covered_platform"), (2, "osm", None, "covered_platform")], "restaurant_id int, source string, phone_e164 string, order_channel string")
    r = spark.createDataFrame([(1, None), (2, "x"), (3, " ")], "id int, phone string")
    got = {x.id: x for x in resolve.contacts(r, c).collect()}
    assert (got[1].phone, got[1].phone_confidence, got[1].phone_source, got[1].order_channel, got[1].set_phone) == ("+321", "high", "osm+website", "direct", True)
    assert (got[2].phone, got[2].order_channel, got[2].set_phone, got[3].order_channel) == (None, "covered_platform", False, "unknown")


def test_upsert_again_changes_nothing(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "k int, fee int, url string")
    new = spark.createDataFrame([(1, None, "c"), (3, 7, None)], "k int, fee int, url string")
    once = mutate.upsert(old, new, ["k"], ("fee",))
    assert sorted(map(tuple, once.collect())) == [(1, 5, "c"), (2, 6, "b"), (3, 7, None)]
    assert sorted(map(tuple, mutate.upsert(once, new, ["k"], ("fee",)).collect())) == sorted(map(tuple, once.collect()))


def test_merge_keeps_listings(spark):
    rows = spark.createDataFrame([(1, 10, "x", dt.datetime(2024, 1, 1)), (2, 20, "x", dt.datetime(2024, 1, 2)), (3, 20, "y", None), (4, 10, "z", None), (5, 20, "z", None)], "id int, restaurant_id int, platform string, last_scraped_at timestamp")
    pairs = spark.createDataFrame([(10, 20)], "survivor_id int, loser_id int")
    assert sorted((r.id, r.restaurant_id) for r in mutate.merge_listings(rows, pairs).collect()) == [(2, 10), (3, 10), (4, 10)]


def test_merge_fills(spark):
    rows = spark.createDataFrame([(1, None, "w"), (2, "p", "v"), (3, None, None)], "id int, phone string, website string")
    pairs = spark.createDataFrame([(1, 2)], "survivor_id int, loser_id int")
    assert sorted(map(tuple, mutate.merge_restaurants(rows, pairs).collect())) == [(1, "p", "w"), (3, None, None)]


def test_decisions_unordered(spark):
    old = spark.createDataFrame([("a", "b", 1.0)], "survivor_id string, loser_id string, score double")
    new = spark.createDataFrame([("b", "a", 2.0)], "survivor_id string, loser_id string, score double")
    assert [tuple(r) for r in mutate.decide_pairs(old, new).collect()] == [("b", "a", 2.0)]


def test_replace_children(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "listing_id int, title string")
    new = spark.createDataFrame([(1, "c")], "listing_id int, title string")
    assert sorted(map(tuple, mutate.replace_children(old, new, "listing_id").collect())) == [(1, "c"), (2, "b")]


def test_pair_menus(spark):
    rows = [
        (1, "uber_eats", 1, "Cheeseburger", None, 8.0, []), (1, "deliveroo", 1, "Cheese Burger", None, 8.2, []), (1, "takeaway", 1, "Cheeseburger Deluxe", None, 12.0, []),
        (1, "uber_eats", 2, "Cola", None, 2.5, []), (1, "uber_eats", 3, "Cola", None, 3.0, []), (1, "deliveroo", 2, "Cola 33 cl", None, 2.5, []),
    ]
    items = spark.createDataFrame(rows, "restaurant_id int, platform string, position int, title string, category string, price double, allergens array<string>")
    got = {r.dish_key: (r.uber_eats, r.deliveroo, r.takeaway) for r in compare.pair_menus(items).collect()}
    assert got == {"cheeseburger": (800, 820, None), "cheeseburger deluxe": (None, None, 1200), "cola": (250, 250, None), "cola::2": (300, None, None)}


def test_basket_rules(spark):
    items = spark.createDataFrame([(1, 2, 500, 450, None, None), (1, 1, 300, None, 200, None)], "basket_id int, qty int, uber_eats int, deliveroo int, takeaway int, direct int")
    fees = spark.createDataFrame([(1, 199, 0, None, None), (2, 199, 100, None, None)], "basket_id int, uber_eats int, deliveroo int, takeaway int, direct int")
    totals = {(r.basket_id, r.platform): (r.total, r.complete) for r in compare.basket_totals(items, fees).collect()}
    assert totals == {(1, "uber_eats"): (1499, True), (1, "deliveroo"): (900, False), (2, "uber_eats"): (199, True), (2, "deliveroo"): (100, True)}
    assert {r.basket_id: r.platform for r in compare.cheapest_complete(compare.basket_totals(items, fees)).collect()} == {1: "uber_eats", 2: "deliveroo"}


def test_deal_score(spark):
    rows = [(1, "pct_discount", 20.0, 4.0), (2, "abs_discount", 0.0, None), (3, "bogo", None, 0.0), (4, "other", 9.0, 5.0)]
    d = spark.createDataFrame(rows, "id int, promo_type string, value double, rating double").withColumn("s", rank.quality_score(F.struct("promo_type", "value", "rating")))
    assert [r.s for r in d.orderBy("id").collect()] == [48.0, 0.0, 30.0, 10.0]


def test_shelves(spark):
    rows = spark.createDataFrame([(1, 9, 9, None), (2, 5, 8, 1)], "id int, a int, b int, c int")
    got = rank.shelves(rows, [("first", F.col("a")), ("second", F.col("b")), ("third", F.col("c"))], "id").collect()
    assert [tuple(r) for r in got] == [("first", 1), ("second", 2)]


def test_builder(spark):
    rows = spark.createDataFrame([(1, "a%b"), (2, "axb"), (3, None)], "id int, name string")
    q = lambda: builder.from_table(rows)
    assert [r.id for r in q().ilike("name", "A%B").execute().collect()] == [1]
    assert [r.id for r in q().ilike("name", "a%b", raw=True).order("id").execute().collect()] == [1, 2]
    assert q().in_("id", []).execute().count() == 0 and q().not_.in_("id", []).execute().count() == 3
    assert [r.id for r in q().not_.is_("name", None).order("id", desc=True).limit(1).execute().collect()] == [2]
    with pytest.raises(ValueError):
        q().select("id; drop table x")


def test_cards_and_seeds(spark):
    c = spark.createDataFrame([(1, "Promo\nPizza Vito\n4,7 (120)\n€ 2,49\n20–30 min\n20% off")], "id int, card string")
    r = payloads.cards(c).first()
    assert (r.name, r.rating, r.delivery_fee, r.eta_min, r.eta_max, r.promotions[0].promo_type) == ("Pizza Vito", 4.7, 2.49, 20, 30, "pct_discount")
    s = spark.createDataFrame([("A", "u", "4,9", "9.999+", "25 min", "Livraison offerte"), ("B", "u", "N/A", "N/A", "N/A", "€2.99")], "name string, url string, rating string, reviewCount string, eta string, deliveryFee string")
    assert [tuple(x)[2:] for x in payloads.seed_listings(s).collect()] == [(4.9, 9999, 25, 0.0), (None, None, None, 2.99)]


def test_store_feed(spark):
    import json

    item = lambda u, n: {"type": "REGULAR_STORE", "uuid": u, "store": {"title": {"text": n}, "rating": {"text": "4,7"}}}
    feed = json.dumps({"feedItems": [item("a", "A"), item("a", "A again"), item("", "B"), item("", "C"), {"type": "AD", "uuid": "z"}]})
    got = payloads.store_feed(spark.createDataFrame([(1, feed)], "id int, payload string")).collect()
    assert sorted(r.name for r in got) == ["A", "B", "C"] and {r.rating for r in got} == {4.0}


def test_stream_upserts(spark, tmp_path):
    """Two micro-batches into a snapshot, the second with a null that must not erase a fee."""
    schema = "k int, at int, delivery_fee int"
    source, held = tmp_path / "in", {"now": spark.createDataFrame([], schema)}
    source.mkdir()

    def write(df):
        held["now"] = spark.createDataFrame(df.collect(), schema)

    sink = state.upsert_sink(lambda: held["now"], write, ["k"], "at")
    for n, rows in enumerate([[(1, 1, 5), (2, 1, 6)], [(1, 2, None), (1, 1, 9)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source / f"b{n}"))
        q = spark.readStream.schema(schema).json(str(source / "*")).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(map(tuple, held["now"].collect())) == [(1, 2, 5), (2, 1, 6)]


def test_windowed_stream(spark, tmp_path):
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, 0)), ("a", dt.datetime(2024, 1, 1, 0, 5))], "k string, at timestamp").coalesce(1).write.json(str(tmp_path / "in" / "b"))
    s = spark.readStream.schema("k string, at timestamp").json(str(tmp_path / "in" / "*"))
    q = state.windowed_counts(s, "k", "at").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").agg(F.max("count")).first()[0] == 2
