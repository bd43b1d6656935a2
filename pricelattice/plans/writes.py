"""More registered queries: writes, resolution and orders over the driver's tables, each beside the same query in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import builder, compare, mutate, rank, reads, resolve
from ..sources import payloads
from .queries import _ALL4, DISHES, QUERIES, SQL, _dishes, _fresh, _re, part_features, parts_in_brands, query
from .tables import FRESH, LISTINGS, as_of, listings, read


def _customers(spark, d):
    return read(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("created_at"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("website"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("phone"),
    )


@query("""WITH r AS (SELECT c_custkey AS id, c_nationkey AS at, (c_custkey % 3 = 0 AND c_name IS NOT NULL)::INT + (c_custkey % 5 <> 0 AND c_mktsegment IS NOT NULL)::INT AS known FROM customer)
 SELECT CASE WHEN first THEN a ELSE b END AS survivor_id, CASE WHEN first THEN b ELSE a END AS loser_id FROM (SELECT a.id AS a, b.id AS b, (a.at, -a.known, a.id) <= (b.at, -b.known, b.id) AS first FROM r a JOIN r b ON b.id = a.id + 1)""")
def merge_survivors(spark, d):
    """Who survives of two: the older, then the better known, then the first."""
    r = _customers(spark, d)
    pairs = r.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return resolve.survivors(pairs, r)


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS a, c_custkey + 1 + c_custkey % 3 AS b, (c_custkey * 37) % 11 AS total FROM customer), o AS (SELECT *, row_number() OVER (ORDER BY total DESC, a, b) AS n FROM p),
 r AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS a, NULL::BIGINT AS b UNION ALL SELECT o.n, CASE WHEN list_contains(used, o.a) OR list_contains(used, o.b) THEN used ELSE list_concat(used, [o.a, o.b]::BIGINT[]) END,
  CASE WHEN list_contains(used, o.a) OR list_contains(used, o.b) THEN NULL ELSE o.a END, CASE WHEN list_contains(used, o.a) OR list_contains(used, o.b) THEN NULL ELSE o.b END FROM r JOIN o ON o.n = r.n + 1)
 SELECT a, b FROM r WHERE a IS NOT NULL""")
def greedy_pairs(spark, d):
    """The merges of a pass in order of evidence, each merchant in one at most."""
    c = F.col("c_custkey").cast("long")
    return resolve.greedy_merges(read(spark, d, "customer").select(c.alias("a"), (c + 1 + c % 3).alias("b"), ((c * 37) % 11).cast("double").alias("total")), few=1000)


@query(f"SELECT a, b, total FROM ({SQL['evidence_bands']}) WHERE decision = 'separate' AND total >= 0.5 AND total < 1.5 ORDER BY total DESC, a, b LIMIT 50")
def near_misses(spark, d):
    """Pairs that were nearly queued, the fifty nearest."""
    return resolve.near_misses_within(parts_in_brands(spark, d), "p_brand", part_features)


def _decisions(spark, d):
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("survivor_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") + 1).alias("loser_id"),
        F.when(F.col("o_orderstatus") == "O", "queued").otherwise("merged").alias("status"), F.lit(None).cast("string").alias("resolved_by"), F.lit(None).cast("timestamp").alias("resolved_at"),
    )


_DEC = "dec AS (SELECT o_orderkey AS id, o_custkey AS survivor_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey + 1 END AS loser_id, CASE o_orderstatus WHEN 'O' THEN 'queued' ELSE 'merged' END AS status FROM orders)"


@query(f"WITH {_DEC} SELECT id, status FROM dec WHERE loser_id IS NOT NULL AND NOT (status = 'queued' AND survivor_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0))")
def pruned_queue(spark, d):
    """The queue without pairs that are separate by now."""
    again = read(spark, d, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"), F.when(F.col("c_custkey") % 2 == 0, "separate").otherwise("queue").alias("decision"))
    return mutate.prune_queue(_decisions(spark, d), again).select("id", "status")


@query(f"WITH {_DEC} SELECT id, CASE WHEN id % 5 = 0 THEN 'kept_apart' ELSE status END AS status, id % 5 = 0 AS settled FROM dec WHERE loser_id IS NOT NULL")
def resolved_decisions(spark, d):
    """Decisions with the verdicts of reviewers; those without a loser go."""
    x = _decisions(spark, d)
    verdicts = x.where("id % 5 = 0").select("id", F.lit("kept_apart").alias("status"), F.lit("reviewer").alias("resolved_by"))
    out = mutate.resolve_decisions(x, verdicts, F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return out.select("id", "status", F.col("resolved_at").isNotNull().alias("settled"))


@query(f"""WITH {_DEC}, {LISTINGS}, per AS (SELECT restaurant_id, count(*) AS n, sum(fee_cents)::BIGINT AS fees FROM l GROUP BY 1)
 SELECT id, coalesce(s.n, 0)::BIGINT AS survivor_listings, coalesce(t.fees, 0)::BIGINT AS loser_fees FROM dec LEFT JOIN per s ON s.restaurant_id = survivor_id LEFT JOIN per t ON t.restaurant_id = loser_id WHERE status = 'queued'""")
def review_queue(spark, d):
    """Open decisions with the listings of both sides, seen through their number and fees."""
    out = reads.review_queue(_decisions(spark, d), listings(spark, d), ["platform", "fee_cents"])
    fees = F.aggregate("loser_listings", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["fee_cents"], F.lit(0)))
    return out.select("id", F.coalesce(F.size("survivor_listings"), F.lit(0)).cast("long").alias("survivor_listings"), F.coalesce(fees, F.lit(0).cast("long")).alias("loser_fees"))


@query("""WITH o AS (SELECT o_orderkey AS a, o_custkey AS b, 'old' AS kind FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_custkey AS a, o_orderkey AS b, 'new' AS kind FROM orders WHERE o_orderkey % 3 = 0)
 SELECT least(a, b) AS low, greatest(a, b) AS high, kind FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE least(n.a, n.b) = least(o.a, o.b) AND greatest(n.a, n.b) = greatest(o.a, o.b)) UNION ALL SELECT least(a, b), greatest(a, b), kind FROM n""")
def decided_pairs(spark, d):
    """Decisions by unordered pair, new ones in place of old ones."""
    o = read(spark, d, "orders")
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("survivor_id"), F.col("o_custkey").alias("loser_id"), F.lit("old").alias("kind"))
    new = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("survivor_id"), F.col("o_orderkey").alias("loser_id"), F.lit("new").alias("kind"))
    return mutate.decide_pairs(old, new).select(F.least("survivor_id", "loser_id").alias("low"), F.greatest("survivor_id", "loser_id").alias("high"), "kind")


@query("""SELECT c_custkey AS id, CASE c_nationkey % 4 WHEN 0 THEN TRUE ELSE c_mktsegment LIKE 'B%' END AS is_chain FROM customer""")
def raised_chains(spark, d):
    """Chain flags, raised by first words and never lowered."""
    c = read(spark, d, "customer")
    r = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 4 == 0, True).when(F.col("c_nationkey") % 4 == 1, F.lit(None).cast("boolean")).otherwise(False).alias("is_chain"), "c_mktsegment")
    tokens = c.where("c_mktsegment like 'B%'").select(F.col("c_mktsegment").alias("token"))
    return mutate.raise_chains(r, tokens, F.col("c_mktsegment")).select("id", "is_chain")


@query("SELECT l_orderkey * 10 + l_linenumber AS listing_id, CASE WHEN l_tax > 0.04 THEN l_extendedprice END AS delivery_fee, CASE WHEN l_linenumber = 1 THEN l_quantity::INT END AS eta_min FROM lineitem WHERE l_tax > 0.04 OR l_linenumber = 1")
def fee_snapshots(spark, d):
    """History rows in which any fee is known."""
    li = read(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("listing_id"), F.when(F.col("l_tax") > 0.04, F.col("l_extendedprice")).alias("delivery_fee"),
        F.when(F.col("l_linenumber") == 1, F.col("l_quantity").cast("int")).alias("eta_min"), F.lit(None).cast("int").alias("eta_max"), F.lit(None).cast("int").alias("min_order"),
    )
    return mutate.snapshots(li, F.lit("2026-01-01 00:00:00").cast("timestamp")).select("listing_id", "delivery_fee", "eta_min")


@query("WITH n AS (SELECT * FROM lineitem WHERE l_returnflag = 'R'), o AS (SELECT * FROM lineitem WHERE l_returnflag <> 'R') SELECT l_orderkey, l_linenumber, l_returnflag FROM o WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n) UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag FROM n")
def replaced_children(spark, d):
    """A touched order's lines give way to its new ones."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return mutate.replace_children(li.where("l_returnflag <> 'R'"), li.where("l_returnflag = 'R'"), "l_orderkey")


@query("""WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN NULL ELSE c_name END AS phone FROM customer), p AS (SELECT DISTINCT o_custkey AS id FROM orders)
 SELECT r.id, coalesce(nullif(phone, ''), CASE WHEN p.id IS NOT NULL THEN 'n' || p.id END, phone) AS phone FROM r LEFT JOIN p USING (id)""")
def filled_phones(spark, d):
    """Missing or empty phones filled, known ones kept."""
    k = F.col("c_custkey")
    r = read(spark, d, "customer").select(k.alias("id"), F.when(k % 4 == 0, "").when(k % 4 == 1, F.lit(None)).otherwise(F.col("c_name")).alias("phone"))
    p = read(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("phone", F.concat(F.lit("n"), F.col("id").cast("string")))
    return mutate.fill_if_empty(r, p, "id", ["phone"], ("phone",))


@query("""WITH r AS (SELECT c_custkey AS id, c_acctbal AS lat, c_nationkey % 4 AS rk FROM customer), p AS (SELECT o_custkey AS id, max(o_totalprice) AS lat, max(o_orderkey) % 4 AS rk FROM orders GROUP BY 1)
 SELECT r.id, CASE WHEN coalesce(p.rk > r.rk, FALSE) THEN p.lat ELSE r.lat END AS lat FROM r LEFT JOIN p USING (id)""")
def ranked_points(spark, d):
    """Points overwritten only by a source that ranks strictly higher."""
    r = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("lat"), (F.col("c_nationkey") % 4).cast("string").alias("geo_source"))
    p = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("lat"), (F.max("o_orderkey") % 4).cast("string").alias("geo_source"))
    return mutate.patch_ranked(r, p, "id", ["lat"], lambda c: c.cast("int")).select("id", "lat")


@query("""SELECT event_id, CASE WHEN user_id % 3 = 1 AND ts < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR THEN 'failed' WHEN user_id % 3 = 1 THEN 'running' ELSE 'success' END AS status FROM events""")
def closed_orphans(spark, d):
    """Runs that began long ago and never ended count as failed."""
    e = read(spark, d, "events")
    runs = e.select("event_id", F.when(F.col("user_id") % 3 == 1, "running").otherwise("success").alias("status"), F.col("ts").alias("started_at"), F.lit(None).cast(dict(e.dtypes)["ts"]).alias("finished_at"))
    return mutate.close_orphans(runs, as_of(e, "ts"), 12).select("event_id", "status")


@query("""SELECT c_custkey AS id, c_custkey % 3 = 1 OR c_custkey % 2 = 0 AS verified FROM customer WHERE NOT c_custkey % 3 = 2""")
def settled_claims(spark, d):
    """Claims after verdicts: approved ones are verified, rejected ones gone."""
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select(k.alias("id"), (k % 2 == 0).alias("verified"))
    return mutate.settle_claims(c, c.where("id % 3 <> 0").select("id", (F.col("id") % 3 == 1).alias("approve")))


_MAIL = "CASE c_custkey % 4 WHEN 0 THEN 'a' || c_custkey || '@x.be' WHEN 1 THEN 'a b@x.be' WHEN 2 THEN NULL ELSE 'a@b@c.d' END"


@query(f"SELECT c_custkey AS id FROM customer WHERE NOT coalesce(regexp_matches({_MAIL}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'), FALSE) OR (c_custkey % 3 = 0 AND c_custkey % 5 <> 0)")
def claim_errors(spark, d):
    """Claims that break a rule."""
    k = F.col("c_custkey")
    mail = F.when(k % 4 == 0, F.concat(F.lit("a"), k.cast("string"), F.lit("@x.be"))).when(k % 4 == 1, "a b@x.be").when(k % 4 == 2, F.lit(None)).otherwise("a@b@c.d")
    c = read(spark, d, "customer").select(k.alias("id"), mail.alias("owner_email"), F.when(k % 3 != 0, k).alias("restaurant_id"), F.when(k % 5 == 0, F.col("c_name")).alias("restaurant_name_free"))
    return mutate.claim_errors(c).select("id")


@query(f"""WITH {LISTINGS}, m AS (SELECT max(last_scraped_at) AS at FROM o), x AS (SELECT restaurant_id, max(last_scraped_at) AS seen FROM l WHERE platform = 'direct' GROUP BY 1) SELECT p_partkey AS id FROM part LEFT JOIN x ON restaurant_id = p_partkey, m WHERE seen IS NULL OR seen < m.at - INTERVAL 400 DAY""")
def stale_direct(spark, d):
    """Merchants whose direct listing is absent or old."""
    r = read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return reads.stale_or_missing(r, listings(spark, d), as_of(read(spark, d, "lineitem"), "l_shipdate"), 400).select("id")


@query(f"WITH {LISTINGS} SELECT restaurant_id, min(last_scraped_at) AS oldest, max(last_scraped_at) AS newest, min(eta_min) AS fastest FROM l GROUP BY 1")
def listing_extremes(spark, d):
    """The oldest and newest capture and the least arrival time."""
    return reads.extremes(listings(spark, d))


@query("SELECT user_id AS run_id, max(value) AS ram_peak, floor(avg(value))::BIGINT AS ram_avg, sum(event_id % 3)::BIGINT AS errors, count(*) AS samples FROM events GROUP BY 1")
def run_metrics(spark, d):
    """Memory and counters of runs."""
    return reads.run_metrics(read(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("value").alias("ram_mb"), (F.col("event_id") % 3).alias("errors")))


@query("""WITH m AS (SELECT p_size AS restaurant_id, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS category, p_name AS title FROM part) SELECT restaurant_id, coalesce(category, 'Other') AS category, count(*) AS n, min(title) AS first_title FROM m WHERE contains(lower(title), 'a') GROUP BY 1, 2""")
def menu_by_category(spark, d):
    """A menu's items under their category."""
    p = read(spark, d, "part").select(F.col("p_size").alias("restaurant_id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("category"), F.col("p_name").alias("title"))
    return reads.by_category(p, "A").select("restaurant_id", "category", F.size("titles").cast("long").alias("n"), F.col("titles")[0].alias("first_title"))


SUMMARY = f"""s AS ({SQL['listing_summary']}), y AS (SELECT *, id % 9 = 0 AS is_chain, CASE WHEN id % 4 = 0 THEN 'ordering' WHEN id % 4 = 1 THEN 'info' END AS direct_url_type, (id * 7 % 40)::INT AS eta_min, (CASE WHEN id % 3 = 0 THEN id % 50 ELSE 0 END)::INT AS closed_rank FROM s)"""


def _summary(spark, d):
    k = F.col("id")
    out = QUERIES["listing_summary"](spark, d)
    return out.withColumns({"is_chain": k % 9 == 0, "direct_url_type": F.when(k % 4 == 0, "ordering").when(k % 4 == 1, "info"), "eta_min": (k * 7 % 40).cast("int"), "closed_rank": F.when(k % 3 == 0, k % 50).otherwise(0).cast("int"), "platform_count": F.col("offers")})


@query(f"WITH {SUMMARY} SELECT id FROM y ORDER BY offers + CASE WHEN direct_url_type = 'ordering' THEN 0.5 ELSE 0 END DESC, is_chain, savings DESC, id LIMIT 40")
def listing_order_top(spark, d):
    """The head of the listing page."""
    return rank.listing_order(_summary(spark, d)).limit(40).select("id")


@query(f"WITH {SUMMARY} SELECT id FROM y ORDER BY closed_rank, CASE WHEN closed_rank = 0 THEN -offers ELSE 0 END, CASE WHEN closed_rank = 0 AND direct_url_type IS NOT NULL THEN 0 ELSE 1 END, savings DESC, id LIMIT 40")
def feed_order_top(spark, d):
    """The head of the feed, open merchants first."""
    return rank.feed_order(_summary(spark, d)).limit(40).select("id")


@query(f"WITH {SUMMARY} SELECT id, savings FROM y WHERE savings > 0 ORDER BY savings DESC, id LIMIT 6")
def best_value(spark, d):
    """The six that save most."""
    return rank.best_value(_summary(spark, d)).select("id", "savings")


@query(f"WITH {SUMMARY} SELECT id AS restaurant_id FROM y WHERE cheapest_platform = 'direct' AND savings > 0")
def direct_winners(spark, d):
    """Merchants whose own site is cheapest."""
    return rank.direct_winners(_fresh(spark, d)).select("restaurant_id").join(read(spark, d, "part").select(F.col("p_partkey").alias("restaurant_id")), "restaurant_id", "left_semi")


@query(f"WITH {SUMMARY}, c AS (SELECT y.id, savings, p_brand FROM y JOIN part ON p_partkey = y.id) SELECT id, savings FROM c WHERE p_brand = (SELECT min(p_brand) FROM part) AND (SELECT count(*) FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)) >= 3")
def cuisine_page(spark, d):
    """The page of one cuisine, where it has three merchants."""
    p = read(spark, d, "part")
    first = reads.first_values(p.select(F.col("p_brand").alias("cuisine")), "cuisine", 1).first()
    x = _summary(spark, d).join(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cuisine")), "id")
    return rank.page(x, "cuisine", first[0] if first else "").select("id", "savings")


@query(f"WITH {DISHES}, k AS (SELECT restaurant_id, dish, list_max({_ALL4}) - list_min({_ALL4}) AS spread FROM dish WHERE len({_ALL4}) >= 2) SELECT dish, spread FROM k ORDER BY spread DESC, dish OFFSET 10 LIMIT 10")
def menu_scanner(spark, d):
    """The second page of dishes by price spread."""
    return rank.scan_page(_dishes(spark, d).withColumn("dish_key", F.col("dish")), 1).select("dish", "spread")


@query(f"WITH {FRESH}, c AS (SELECT restaurant_id, list(fee_cents ORDER BY fee_cents) AS s FROM f WHERE fee_cents IS NOT NULL GROUP BY 1) SELECT restaurant_id, (s[2] - s[1])::INT AS savings FROM c WHERE len(s) >= 2 AND s[2] > s[1] ORDER BY savings DESC, restaurant_id LIMIT 1")
def best_saving(spark, d):
    """The merchant that saves most."""
    return rank.best_saving(_fresh(spark, d)).select("restaurant_id", "savings")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, greatest(CASE WHEN l_linenumber <> 3 THEN floor(l_extendedprice)::BIGINT ELSE 0 END, 1500) + l_linenumber AS total, floor(floor(l_extendedprice) * 0.7 + 0.5)::BIGINT AS kept, round_even(l_quantity / 2, 0) AS rounded FROM lineitem")
def commission_rows(spark, d):
    """Least orders, commissions and halves to even."""
    li = read(spark, d, "lineitem")
    whole = F.floor("l_extendedprice")
    kept = compare.kept_after_commission(whole, {"uber_eats": 0.3})
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), compare.effective_total(F.when(F.col("l_linenumber") != 3, whole), F.lit(1500), F.col("l_linenumber")).cast("long").alias("total"),
        kept["uber_eats"].cast("long").alias("kept"), geo.half_even(F.col("l_quantity") / 2).alias("rounded"),
    )


_NON = " ".join(f"WHEN regexp_matches(x, '(?i){_re(p)}') THEN '{why}'" for p, why in text.NON_FOOD)
_SHOPS = "['Carrefour Market', 'Proxy Delhaize', 'Night-Shop', 'Librairie', 'Tom & Co', 'Wines and Spirits', 'Candy & Go', 'Flowers Forever', 'Vidéo-Box', 'Pizza Roma', 'Tomco']"


@query(f"""WITH t AS (SELECT doc_id, ({_SHOPS}[(doc_id % 11 + 1)::INT] || ' ' || coalesce(text, '')) AS name, coalesce(source, '') AS slug FROM documents), k AS (SELECT doc_id, name, name || ' ' || slug AS x FROM t)
 SELECT doc_id, CASE {_NON} END AS reason, length(trim(name)) < 4 OR regexp_matches(trim(name), '{_re(text.PAGE_JUNK)}') OR regexp_matches(trim(name), '[☀-➿\U00010000-\U0010ffff]') AS junk FROM k""")
def shop_kinds(spark, d):
    """Shops that sell no meals, and names that are none."""
    shops = F.array(*[F.lit(x) for x in ("Carrefour Market", "Proxy Delhaize", "Night-Shop", "Librairie", "Tom & Co", "Wines and Spirits", "Candy & Go", "Flowers Forever", "Vidéo-Box", "Pizza Roma", "Tomco")])
    name = F.concat(F.element_at(shops, (F.col("doc_id") % 11 + 1).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    return read(spark, d, "documents").select("doc_id", text.non_food(name, F.coalesce("source", F.lit(""))).alias("reason"), text.is_page_junk(name).alias("junk"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 AND NOT c_custkey % 2 = 0 THEN '{\"tags\": [null, 1]}' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE NOT coalesce(c_nationkey = 5, FALSE) UNION ALL SELECT 0, 'new'")
def builder_writes(spark, d):
    """Update, delete and insert by the fluent query."""
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", (F.col("c_custkey") % 2 == 0).alias("even"))
    c = builder.from_table(c).eq("c_nationkey", 3).not_.eq("even", True).update({"c_mktsegment": {"tags": [None, 1]}})
    c = builder.from_table(c).eq("c_nationkey", 5).delete()
    return builder.from_table(c).insert({"c_custkey": 0, "c_mktsegment": "new"}).select("c_custkey", "c_mktsegment")


_SEEN = "(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 30 DAY ELSE o_orderdate END)"


@query(f"""WITH x AS (SELECT o_orderkey FROM orders WHERE {_SEEN} < (SELECT max(o_orderdate) FROM orders) - INTERVAL 700 DAY)
 SELECT (SELECT count(*) FROM x) AS deleted, count(*) AS pruned FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM x)""")
def daily_cleanup(spark, d):
    """What the daily clean-up deletes: orders as listings, their lines as children."""
    o = read(spark, d, "orders")
    seen = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("scraped_at"), seen.alias("last_scraped_at"))
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("listing_id"), "l_linenumber")
    return mutate.clean_up(rows, lines, as_of(o, "o_orderdate"), 700)[2]


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = c_custkey % 3 THEN 2 ELSE 3 END AS n, coalesce(c_name, '') || CASE WHEN c_custkey % 5 = c_custkey % 3 THEN '' ELSE '|Second' END || '|Unknown' AS names,
 'https://www.ubereats.com/s/' || c_custkey || CASE WHEN c_custkey % 5 = c_custkey % 3 THEN '|' ELSE '||' END AS urls FROM customer""")
def search_answers(spark, d):
    """Answers of a search, two pages each with a repeated store, an advertisement and stores without a name."""
    k = F.col("c_custkey")
    one = F.format_string('[{"type":"REGULAR_STORE","uuid":"u","store":{"storeUuid":"%d","title":{"text":"%s"},"actionUrl":"/s/%d?x=1"}},{"type":"AD","store":{}}]', k % 5, F.coalesce("c_name", F.lit("")), k)
    two = F.format_string('[{"type":"REGULAR_STORE","uuid":"%d","store":{"title":{"text":"Second"}}},{"type":"REGULAR_STORE","store":null}]', k % 3)
    c = payloads.search_candidates(read(spark, d, "customer").select(k, F.array(one, two).alias("pages")), "c_custkey")
    return c.select("c_custkey", F.size("candidates").alias("n"), F.array_join("candidates.name", "|").alias("names"), F.array_join("candidates.url", "|").alias("urls"))
