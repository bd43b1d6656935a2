"""Price comparison: menu pivot and fuzzy absorption, baskets, coverage, direct savings, menu statistics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, geo, text
from ..functions.similarity import jaro_winkler

PRICES = "struct<" + ",".join(f"{p}:int" for p in dims.PLATFORMS) + ">"
# When two titles are one dish.
ALIKE, ALIKE_SAME_PRICE, LENGTHS, APART = 0.88, 0.78, 0.75, 0.20


def menu_rows(items: DataFrame) -> DataFrame:
    """(restaurant_id, platform, title, ..., price) with keys: title_key, words for fuzzy scoring, shown name."""
    shown = F.trim(F.regexp_replace("title", text.EMOJI, ""))
    return items.withColumns({"base": text.title_key(F.col("title"), F.col("category")), "norm": text.title_words(F.col("title")), "shown": shown, "cents": geo.cents(F.col("price"))})


def _pair_menu(items: list[dict]) -> list[dict]:
    """One restaurant's items to merged dishes, in platform order and position."""
    order = {p: k for k, p in enumerate(dims.PLATFORMS)}
    dishes: dict[str, dict] = {}
    last = lambda x, least: (x is None, least if x is None else x)
    at = lambda r: (order.get(r["platform"], len(order)), last(r["position"], 0), last(r["title"], ""), last(r["cents"], 0), last(r["category"], ""), r["allergens"] or [])
    for r in sorted(items, key=at):
        slot, key = 1, r["base"]
        while key in dishes and r["platform"] in dishes[key]["prices"]:
            slot += 1
            key = f"{r['base']}::{slot}"
        d = dishes.setdefault(key, {"name": r["shown"], "norm": r["norm"], "category": r["category"], "prices": {}, "allergens": frozenset()})
        if r["cents"] is not None:
            d["prices"][r["platform"]] = int(r["cents"])
        if not d["allergens"] and r["allergens"]:
            d["allergens"] = frozenset(a.lower() for a in r["allergens"])
    merged: list[dict] = []
    waiting = list(dishes.items())
    gone: set[str] = set()
    for i, (key, a) in enumerate(waiting):
        if key in gone:
            continue
        for other, b in waiting[i + 1 :]:
            if other in gone or a["prices"].keys() & b["prices"].keys() or not _alike(a, b):
                continue
            for p, price in b["prices"].items():
                a["prices"].setdefault(p, price)
            a["allergens"] = a["allergens"] or b["allergens"]
            gone.add(other)
        merged.append({"key": key, **a})
    return merged


def _pair_menus(batches):
    """Batches of (restaurant_id, items) to dishes, a few menus at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            found = [(k, d) for k, items in enumerate(part.column("items").to_pylist()) for d in _pair_menu(items)]
            columns = [pa.array([d[c] for _, d in found], pa.string()) for c in ("key", "name", "category")]
            prices = [pa.array([d["prices"].get(p) for _, d in found], pa.int32()) for p in dims.PLATFORMS]
            rid = part.column("restaurant_id").take(pa.array([k for k, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([rid, *columns, *prices], ["restaurant_id", "dish_key", "name", "category", *dims.PLATFORMS])


def _alike(a: dict, b: dict) -> bool:
    x, y = a["norm"], b["norm"]
    if not max(len(x), len(y)) or min(len(x), len(y)) / max(len(x), len(y)) < LENGTHS:
        return False
    price = lambda d: next((d["prices"][p] for p in dims.PLATFORMS if p in d["prices"]), None)
    pa, pb = price(a), price(b)
    known = pa is not None and pb is not None
    if jaro_winkler(x, y) < (ALIKE_SAME_PRICE if known and pa == pb else ALIKE):
        return False
    if known and max(pa, pb) > 0 and abs(pa - pb) / max(pa, pb) > APART:
        return False
    return not (a["allergens"] and b["allergens"] and not a["allergens"] & b["allergens"])


def pair_menus(items: DataFrame) -> DataFrame:
    """Items (restaurant_id, platform, position, title, category, price, allergens) to dishes with a price for each platform.

    Equal keys are one dish; a second item of a platform under one key is another dish. Then dishes absorb, in order,
    later ones alike in name and price that share no platform. The order decides, so one restaurant is one group; its
    size is bounded by a menu.
    """
    schema = "restaurant_id {}, dish_key string, name string, category string, ".format(dict(items.dtypes)["restaurant_id"]) + ", ".join(f"{p} int" for p in dims.PLATFORMS)
    rows = menu_rows(items).select("restaurant_id", F.struct("platform", "position", "title", "category", "base", "norm", "shown", "cents", "allergens").alias("i"))
    return rows.groupBy("restaurant_id").agg(F.collect_list("i").alias("items")).mapInArrow(_pair_menus, schema)


def pivot_menu(items: DataFrame) -> DataFrame:
    """The exact part in the JVM: dishes by key and slot, without absorption."""
    from pyspark.sql import Window

    rows = menu_rows(items)
    w = Window.partitionBy("restaurant_id", "platform", "base").orderBy("position", "title")
    rows = rows.withColumn("slot", F.row_number().over(w))
    return rows.groupBy("restaurant_id", "base", "slot").pivot("platform", list(dims.PLATFORMS)).agg(F.first("cents"))


def match_rate(dishes: DataFrame, key: str = "restaurant_id") -> DataFrame:
    """Dishes on two platforms or more over dishes that a delivery platform has; and the tier of that rate."""
    n = sum((F.col(p).isNotNull().cast("int") for p in dims.PLATFORMS), F.lit(0))
    delivered = F.greatest(*[F.col(p).isNotNull().cast("int") for p in dims.AGGREGATORS]) == 1
    out = dishes.groupBy(key).agg(F.count_if(n >= 2).alias("matched"), F.count_if(delivered).alias("comparable"))
    rate = F.when(F.col("comparable") > 0, F.col("matched") / F.col("comparable")).otherwise(0.0)
    return out.withColumn("match_rate", rate).withColumn("tier", F.when(rate >= 0.7, 1).when(rate >= 0.3, 2).otherwise(3))


def basket_totals(items: DataFrame, fees: DataFrame, key: str = "basket_id") -> DataFrame:
    """(key, platform, fee, total, priced, items, complete): a platform without a fee has no total; items without a price are left out.

    items: key, qty and a price column for each platform; fees: key and a fee column for each platform.
    """
    sums = items.groupBy(key).agg(
        F.count("*").alias("items"),
        *[F.sum(F.col(p) * F.col("qty")).alias(f"s_{p}") for p in dims.PLATFORMS],
        *[F.count(p).alias(f"n_{p}") for p in dims.PLATFORMS],
    )
    j = fees.join(sums, key, "left")
    offers = F.array(*[F.struct(F.lit(p).alias("platform"), F.lit(k).alias("o"), F.col(p).alias("fee"), F.coalesce(f"s_{p}", F.lit(0)).alias("sub"), F.coalesce(f"n_{p}", F.lit(0)).alias("priced")) for k, p in enumerate(dims.PLATFORMS)])
    out = j.select(key, F.coalesce("items", F.lit(0)).alias("items"), F.explode(offers).alias("x")).where("x.fee is not null")
    return out.select(key, "x.platform", "x.o", "x.fee", (F.col("x.sub") + F.col("x.fee")).alias("total"), "x.priced", "items", (F.col("x.priced") == F.col("items")).alias("complete"))


def cheapest_complete(totals: DataFrame, key: str = "basket_id") -> DataFrame:
    """The cheapest platform that has every item, the first listed in a tie."""
    return totals.where("complete").groupBy(key).agg(F.min(F.struct("total", "o", "platform")).alias("m")).select(key, F.col("m.platform").alias("platform"), F.col("m.total").alias("total"))


def direct_savings(items: DataFrame, fees: DataFrame, key: str = "basket_id") -> DataFrame:
    """What ordering directly saves against the cheapest platform, where three items and half the basket have a direct price.

    Signed; positive_savings keeps only a gain.
    """
    live = items.where("qty > 0").groupBy(key).agg(F.count("*").alias("n"), F.count("direct").alias("d"), F.sum(F.col("direct") * F.col("qty")).alias("sub"))
    others = basket_totals(items, fees, key).where("platform <> 'direct'").groupBy(key).agg(F.min("total").alias("best"))
    out = live.join(others, key).where("d >= 3 and d / n >= 0.5").withColumn("savings", F.col("best") - F.col("sub"))
    return out.select(key, "savings", F.when(F.col("savings") > 0, F.col("savings")).alias("positive_savings"))


def direct_fee_savings(listings: DataFrame, floor: int = 150, key: str = "restaurant_id") -> DataFrame:
    """Mean fee of the platforms less the direct fee (none counts as 0), where that is worth showing."""
    out = listings.groupBy(key).agg(F.avg(F.when(F.col("platform").isin(*dims.AGGREGATORS), F.col("fee_cents"))).alias("mean"), F.max(F.when(F.col("platform") == "direct", F.col("fee_cents"))).alias("direct"))
    return out.withColumn("savings", geo.half_up(F.col("mean") - F.coalesce("direct", F.lit(0)))).where(F.col("savings") >= floor).select(key, "savings")


def menu_averages(dishes: DataFrame, key: str = "restaurant_id") -> DataFrame:
    """(key, platform, avg_cents, priced) over dishes that two delivery platforms price."""
    several = sum((F.col(p).isNotNull().cast("int") for p in dims.AGGREGATORS), F.lit(0)) >= 2
    long_ = dishes.where(several).select(key, F.explode(F.array(*[F.struct(F.lit(p).alias("platform"), F.col(p).alias("cents")) for p in dims.AGGREGATORS])).alias("x")).select(key, "x.*")
    return long_.where("cents is not null").groupBy(key, "platform").agg(geo.half_up(F.avg("cents")).alias("avg_cents"), F.count("*").alias("priced"))


def price_spread(dishes: DataFrame, key: str = "restaurant_id") -> DataFrame:
    """For each restaurant: dishes that differ in price, the mean saving, and how often each platform is cheapest (ties count for all)."""
    known = F.filter(F.array(*[F.col(p) for p in dims.PLATFORMS]), lambda x: x.isNotNull())
    low, high = F.array_min(known), F.array_max(known)
    rows = dishes.where(F.size(known) >= 2).withColumn("low", low).withColumn("spread", high - low).where("spread > 0")
    wins = [F.count_if(F.col(p) == F.col("low")).alias(f"wins_{p}") for p in dims.PLATFORMS]
    return rows.groupBy(key).agg(F.count("*").alias("dishes"), F.avg("spread").alias("mean_saving"), F.max("spread").alias("largest"), *wins)


def effective_total(subtotal: Column, least: Column, fee: Column) -> Column:
    return F.greatest(F.coalesce(subtotal, F.lit(0)), least) + fee


def kept_after_commission(subtotal: Column, rates: dict[str, float]) -> Column:
    """map<platform, what the merchant keeps>."""
    return F.create_map(*[x for p, r in rates.items() for x in (F.lit(p), geo.half_up(subtotal * (1 - r)))])


# Jaro-Winkler adds 0.4 (1 - Jaro) at most, so Jaro is 0.8 at least, and m letters in common give m/|q| + m/|t| + 1 >= 2.4.
SHARED = 3 * (ALIKE - 0.4) / 0.6 - 1 - 1e-9
SALTS = 8


def best_title(queries: DataFrame, items: DataFrame, block: str | None = None) -> DataFrame:
    """For each query name the item of equal words, else the most alike: the first in order of position wins a tie.

    Candidates share `block` (a restaurant, say) if given; else all distinct words of a length that LENGTHS allows are
    candidates. Only pairs with as many letters in common as ALIKE implies are scored; no pair is lost.
    """
    from ..functions.similarity import title_similarity

    own = [block] if block else []
    letters = lambda c: F.transform(F.split(c, ""), lambda x, k: F.concat(x, F.size(F.filter(F.slice(F.split(c, ""), 1, k + 1), lambda y: y == x)).cast("string")))
    named = queries.select("query_id", text.title_words(F.col("name")).alias("q"), *own)
    q = named.select("q", *own).distinct().withColumn("q_letters", letters(F.col("q")))
    i = items.select(F.struct((-F.col("position")).alias("p"), F.col("name").alias("item")).alias("first"), text.title_words(F.col("name")).alias("t"), *own)
    i = i.groupBy("t", *own).agg(F.max("first").alias("first")).withColumn("t_letters", letters(F.col("t")))
    if block:
        pairs = q.join(i, block)
    else:
        n = F.length("q")
        q = q.withColumn("_n", F.explode(F.sequence(F.ceil(n * LENGTHS), F.floor(n / LENGTHS)))).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = q.join(i.withColumn("_n", F.length("t").cast("long")).withColumn("_s", F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int")), ["_n", "_s"])
    ratio = F.least(F.length("q"), F.length("t")) / F.greatest(F.length("q"), F.length("t"))
    common = F.size(F.array_intersect("q_letters", "t_letters"))
    same = F.col("q") == F.col("t")
    pairs = pairs.where(same | ((ratio >= LENGTHS) & (common / F.length("q") + common / F.length("t") >= SHARED))).withColumn("sim", title_similarity(F.col("q"), F.col("t")))
    best = pairs.where(same | (F.col("sim") >= ALIKE)).groupBy("q", *own).agg(F.max(F.struct(same.alias("same"), F.col("sim"), F.col("first.p").alias("p"), F.col("first.item").alias("item"))).alias("m"))
    best = named.join(best, ["q", *own]).groupBy("query_id").agg(F.max("m").alias("m"))
    return best.select("query_id", F.col("m.item").alias("item"), F.col("m.sim").alias("sim"))


def item_cheapest(dishes: DataFrame) -> DataFrame:
    """Each dish with its cheapest platform, the first listed in a tie."""
    offers = F.filter(F.array(*[F.struct(F.col(p).alias("c"), F.lit(k).alias("o"), F.lit(p).alias("platform")) for k, p in enumerate(dims.PLATFORMS)]), lambda x: x["c"].isNotNull())
    return dishes.withColumn("cheapest", F.array_min(offers)["platform"])


def decision_card(items: DataFrame, fees: DataFrame, key: str = "basket_id") -> DataFrame:
    """Each basket's platforms in order of completeness and total, what the next best costs more in percent, and missing names."""
    totals = basket_totals(items, fees, key)
    lacking = items.select(key, "name", F.explode(F.array(*[F.struct(F.lit(p).alias("platform"), F.col(p).isNull().alias("gone")) for p in dims.PLATFORMS])).alias("x")).where("x.gone")
    lacking = lacking.groupBy(key, F.col("x.platform").alias("platform")).agg(F.sort_array(F.collect_list("name")).alias("missing"))
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy((~F.col("complete")), "total", "o")
    out = totals.withColumn("place", F.row_number().over(w)).withColumn("best", F.first("total").over(w))
    percent = F.when(F.col("total") > 0, geo.half_up((F.col("total") - F.col("best")) * 100 / F.col("total"))).otherwise(0)
    return out.join(lacking, [key, "platform"], "left").select(key, "platform", "place", "total", "complete", percent.alias("saves_percent"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def corpus_audit(dishes: DataFrame, key: str = "restaurant_id") -> DataFrame:
    """Shares of dishes on two, three and four platforms, over merchants with menus on two platforms or more."""
    n = sum((F.col(p).isNotNull().cast("int") for p in dims.PLATFORMS), F.lit(0))
    wide = sum((F.max(F.col(p).isNotNull().cast("int")) for p in dims.PLATFORMS), F.lit(0))
    per = dishes.withColumn("n", n).groupBy(key).agg(F.count("*").alias("all"), *[F.count_if(F.col("n") >= k).alias(f"n{k}") for k in (2, 3, 4)], wide.alias("platforms")).where("platforms >= 2")
    total = F.sum("all")
    return per.agg(F.count("*").alias("merchants"), total.alias("dishes"), *[(F.sum(f"n{k}") / total).alias(f"share_{k}") for k in (2, 3, 4)])
