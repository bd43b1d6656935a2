"""Cases of the smaller operators."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pricelattice.functions import geo, hours, text
from pricelattice.operators import compare, mutate, rank, reads, resolve
from pricelattice.plans import cases
from pricelattice.sources import payloads


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_identity(spark):
    k = spark.createDataFrame(cases.KNOWN, "id int, name string, website string")
    got = {r.incoming_id: (r.id, r.rule) for r in resolve.identify(spark.createDataFrame(cases.INCOMING, "id int, name string, website string"), k).collect()}
    assert got == {10: (1, 0), 11: (1, 1), 12: (3, 2), 13: (1, 3), 14: (2, 4), 15: (3, 5), 16: (None, None)}


def test_stores(spark):
    got = [tuple(r) for r in payloads.store_details(spark.createDataFrame(cases.STORES, "id int, payload string")).orderBy("id").collect()]
    assert got == [(0, 15.0, "02 1", "Rue A 1", "1000", "h"), (1, 9.9, "x", "B 2", "1050", "i"), (2, None, None, "C 3", None, None)]


def test_store_promotions(spark):
    p = json.dumps({"promotions": [{"text": "20% off", "value": 25.0}], "offers": [{"label": "20% OFF"}, {"title": "Free delivery"}]})
    got = payloads.store_promotions(spark.createDataFrame([(1, p)], "id int, payload string")).orderBy("label").collect()
    assert [(r.label, r.promo_type, r.value) for r in got] == [("20% off", "pct_discount", 25.0), ("Free delivery", "free_delivery", 0.0)]


def test_section_hours(spark):
    kind = "array<struct<dayRange:string,sectionHours:array<struct<startTime:int,endTime:int>>>>"
    got = one(spark, lambda c: hours.by_day(hours.section_hours(c)), [("Samstag - Montag", [(510, 1170)]), ("Mercredi", [(600, 720), (1080, 1320)]), ("Nowhere", [(1, 2)])], kind)
    assert {d: [tuple(s) for s in v] for d, v in got.items()} == {"sat": [("08:30", "19:30")], "sun": [("08:30", "19:30")], "mon": [("08:30", "19:30")], "wed": [("10:00", "12:00"), ("18:00", "22:00")]}


def test_regular_hours(spark):
    kind = "array<struct<dayOfWeek:string,day:string,startTime:string,open:string,from:string,endTime:string,close:string,to:string>>"
    got = one(spark, hours.regular_hours, [("MONDAY", None, "11:00:00", None, None, "22:30", None, None), (None, "friday", None, "", "10:00", None, None, "12:00"), ("MONDAY", None, None, None, None, "1", None, None)], kind)
    assert [tuple(s) for s in got] == [("mon", "11:00", "22:30"), ("fri", "10:00", "12:00")]


def test_basket_codec(spark):
    got = one(spark, text.basket_decode, "Pizza%3A%20big:2,Cola:0,odd,Tea:1")
    assert [tuple(i) for i in got] == [("Pizza: big", 2), ("Tea", 1)]
    assert one(spark, lambda c: text.basket_decode(text.basket_encode(c)), [("a, b", 3)], "array<struct<name:string,qty:int>>") == [("a, b", 3)]


@pytest.mark.parametrize(("cron", "ok"), [("0 6 * * *", True), ("*/5 0-3,7 * * 1", True), ("0 6 * *", False), ("x 6 * * *", False), (None, False)])
def test_cron(spark, cron, ok):
    assert one(spark, text.is_cron, cron) is ok


def test_names(spark):
    assert one(spark, text.commune_name, "uccle") == "Uccle" and one(spark, lambda c: text.commune_name(c, True), "uccle") == "Ukkel"
    assert one(spark, text.menu_code, "https://www.sq-menu.com/api/fb/abc?x") == "abc" and one(spark, text.menu_code, "https://palace.sq-menu.com/") == "palace"
    assert one(spark, text.shop_slug, "https://piki-app.com/le-grill/menu") == "le-grill"
    assert one(spark, text.slug_key, "wok-up-bruxelles") == "wokup" and one(spark, text.slug_key, "menu") == ""
    assert one(spark, text.house_number, "Chaussée de Haecht 46B") == "46" and one(spark, text.address_key, "Rue Haute 12") == "haute12"


def test_labels(spark):
    assert [one(spark, text.euros, v, "int") for v in (None, 0, 250)] == ["—", "Free", "€2.50"]
    assert [one(spark, lambda c: text.eta_label(c, F.lit(30)), v, "int") for v in (20, 30, None)] == ["20–30 min", "30 min", None]
    assert one(spark, geo.in_region and (lambda c: geo.in_region(c, F.lit(4.3))), 50.8, "double") is True


def test_queue_writes(spark):
    d = spark.createDataFrame([(1, "a", "b", "queued"), (2, "c", "d", "queued"), (3, "e", None, "queued")], "id int, survivor_id string, loser_id string, status string")
    s = spark.createDataFrame([("b", "a", "separate"), ("c", "d", "queue")], "a string, b string, decision string")
    assert [r.id for r in mutate.prune_queue(d, s).collect()] == [2]
    d = d.withColumn("resolved_by", F.lit(None).cast("string")).withColumn("resolved_at", F.lit(None).cast("timestamp"))
    out = mutate.resolve_decisions(d, spark.createDataFrame([(1, "merged", "me")], "id int, status string, resolved_by string"), F.lit(dt.datetime(2024, 1, 1))).orderBy("id").collect()
    assert [(r.id, r.status, r.resolved_by, r.resolved_at is not None) for r in out] == [(1, "merged", "me", True), (2, "queued", None, False)]


def test_claims_and_chains(spark):
    c = spark.createDataFrame([(1, False), (2, False), (3, False)], "id int, verified boolean")
    assert sorted(map(tuple, mutate.settle_claims(c, spark.createDataFrame([(1, True), (2, False)], "id int, approve boolean")).collect())) == [(1, True), (3, False)]
    r = spark.createDataFrame([(1, "Quick Bourse", None), (2, "Solo", True)], "id int, name string, is_chain boolean")
    t = spark.createDataFrame([("quick",)], "token string")
    assert sorted(map(tuple, mutate.raise_chains(r, t, text.first_word(F.col("name"))).collect())) == [(1, "Quick Bourse", True), (2, "Solo", True)]
    e = spark.createDataFrame([("x", 1, None), ("a@b.c", None, None), ("a@b.c", None, "n"), (None, 1, None)], "owner_email string, restaurant_id int, restaurant_name_free string")
    assert mutate.claim_errors(e).count() == 3


def test_reload_and_report(spark, tmp_path):
    mutate.reload(spark.createDataFrame([(1, " "), (1, " "), (2, "t")], "id int, tel string"), str(tmp_path / "p"), ["id"], ("tel",))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).collect())) == [(1, None), (2, "t")]
    mutate.write_report(spark.createDataFrame([("a", "b", 1.0), ("c", "d", 2.0)], "a string, b string, total double"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_presence_rules(spark):
    s = spark.createDataFrame(cases.SEARCHES, cases.SEARCH_SCHEMA)
    got = {r.search_id: r for r in resolve.settle_presence(resolve.presence(s), s).collect()}
    assert (got[1].outcome, got[1].block_reason) == ("uncertain", "no_candidates") and got[4].candidate_name == "Sushi Bar" and got[2].outcome == "present"


def test_feed_and_pages(spark):
    rows = spark.createDataFrame([(1, 0, 2, None, 5, 9), (2, 0, 3, None, 1, 9), (3, 700, 4, "ordering", 9, 1), (4, 0, 3, "ordering", 0, 5), (5, 660, 1, None, 0, None)], "id int, closed_rank int, platform_count int, direct_url_type string, savings int, eta_min int")
    assert [r.id for r in rank.feed_order(rows).collect()] == [4, 2, 1, 5, 3]
    p = spark.createDataFrame([(1, "x", 5), (2, "x", 9), (3, "x", 9), (4, "y", 1)], "id int, cuisine string, savings int")
    assert [r.id for r in rank.page(p, "cuisine", "x").collect()] == [2, 3, 1] and rank.page(p, "cuisine", "y").count() == 0


def test_reads(spark):
    a = spark.createDataFrame([("001",)], "name string")
    b = spark.createDataFrame([("002",), ("001",), ("003",)], "name string")
    assert [r.name for r in reads.pending(a, b).collect()] == ["002", "003"]
    m = spark.createDataFrame([(1, 100, 0), (1, 201, 2)], "run_id int, ram_mb int, errors int")
    assert tuple(reads.run_metrics(m).first()) == (1, 201, 150, 2, 2)
    r = spark.createDataFrame([("123e4567-e89b-12d3-a456-426614174000", "wok"), ("x", "y")], "id string, slug string")
    assert reads.detail(r, "wok").first().slug == "wok" and reads.detail(r, "123e4567-e89b-12d3-a456-426614174000").first().slug == "wok"


def test_mean_memory_in_any_order(spark):
    import itertools

    samples = [(k, x) for k, order in enumerate(itertools.permutations([54.26, 75.07, 14.67])) for x in order]  # 144, or less by a bit
    samples += [(6, 1e300), (6, 1e300), (7, None), (8, None), (8, -1e-20), (9, 9e19), (9, 9e19), (10, float("inf")), (10, 1.0), (11, 0.1 + 0.2), (11, -0.1)]
    rows = spark.createDataFrame(samples, "run_id int, ram_mb double").coalesce(1)
    got = {r.run_id: r.ram_avg for r in reads.run_metrics(rows.withColumn("errors", F.lit(0))).collect()}
    assert [got[k] for k in range(6)] == [48] * 6
    assert (got[7], got[8], got[11]) == (None, -1, 0)
    mean = {r.run_id: r.m for r in rows.groupBy("run_id").agg(geo.exact_mean(F.col("ram_mb")).alias("m")).collect()}
    assert (mean[6], mean[9], mean[10]) == (1e300, 9e19, float("inf"))


def test_decision_card(spark):
    items = spark.createDataFrame([(1, "a", 1, 1000, 900, None, None), (1, "b", 1, 100, None, None, None)], "basket_id int, name string, qty int, uber_eats int, deliveroo int, takeaway int, direct int")
    fees = spark.createDataFrame([(1, 100, 100, None, None)], "basket_id int, uber_eats int, deliveroo int, takeaway int, direct int")
    got = {r.platform: (r.place, r.total, r.missing) for r in compare.decision_card(items, fees).collect()}
    assert got == {"uber_eats": (1, 1200, []), "deliveroo": (2, 1000, ["b"])}


def test_place_and_phone(spark):
    rows = spark.createDataFrame([(1, "Wok House", 50.84, 4.36)], "id int, name string, lat double, lng double")
    places = spark.createDataFrame([("p", "House Wok", 50.8401, 4.36, "1", None), ("q", "Other", 50.84, 4.36, "2", None)], "fsq_place_id string, name string, latitude double, longitude double, tel string, website string")
    assert [(r.fsq_place_id, r.score) for r in resolve.best_place(rows, places).collect()] == [("p", 100)]
    nodes = spark.createDataFrame([("Wok House Brussels", "+321", 50.8402, 4.3601), ("Bar", "+322", 50.84, 4.36)], "name string, phone string, lat double, lng double")
    assert [tuple(r) for r in resolve.phone_by_name(rows, nodes).collect()] == [(1, "+321")]


def test_search_candidates(spark):
    page = json.dumps([{"type": "REGULAR_STORE", "uuid": "a", "store": {"title": {"text": "A"}, "actionUrl": "/s/a?q=1", "mapMarker": {"latitude": 50.8, "longitude": 4.3}}}, {"type": "AD"}, {"type": "REGULAR_STORE", "uuid": "a", "store": {"title": {"text": "again"}}}, {"type": None}])
    more = json.dumps([{"type": "REGULAR_STORE", "uuid": "x", "store": {"storeUuid": "a"}}, {"type": "REGULAR_STORE", "store": None}, {"type": "REGULAR_STORE", "uuid": ""}])
    rows = spark.createDataFrame([(1, [page, more]), (2, [None, "{}", "[", "[]"]), (3, None), (4, []), (1, [page])], "id int, pages array<string>")
    got = sorted((r.id, [tuple(c) for c in r.candidates]) for r in payloads.search_candidates(rows).collect())
    a, none = ("A", "https://www.ubereats.com/s/a", 50.8, 4.3, None), ("Unknown", "", None, None, None)
    assert got == [(1, [a]), (1, [a, none, none]), (2, []), (3, []), (4, [])]


def test_clean_up(spark):
    kind = "id int, scraped_at timestamp, last_scraped_at timestamp"
    t = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    rows = spark.createDataFrame([(1, t(0), None), (2, t(0), t(40)), (3, None, None), (4, t(20), None), (5, t(50), t(1))], kind)
    children = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (5, "c"), (9, "d"), (None, "e")], "listing_id int, title string")
    kept, lines, report = mutate.clean_up(rows, children, F.lit(t(50)), 30)
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4]
    assert sorted(map(tuple, lines.collect()), key=repr) == [(2, "b"), (9, "d"), (None, "e")]
    assert tuple(report.first()) == (2, 3)
    assert tuple(mutate.clean_up(rows.limit(0), children.limit(0), F.lit(t(50)))[2].first()) == (0, 0)
