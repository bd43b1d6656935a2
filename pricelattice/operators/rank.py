"""Cheapest and runner-up, deltas, deal ranking, shelves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims


def platform_order(c: Column) -> Column:
    """Ties go to the platform that is listed first."""
    return F.array_position(F.array(*[F.lit(p) for p in dims.PLATFORMS]), c)


def cheapest(listings: DataFrame, fee: str = "fee_cents", key: str = "restaurant_id", platforms: tuple[str, ...] = dims.PLATFORMS) -> DataFrame:
    """One row for each restaurant with a known fee: winner, its fee and what the runner-up costs more.

    One aggregate: a restaurant has a listing for each platform at most, so its sorted array is short.
    """
    offers = listings.where(F.col(fee).isNotNull() & F.col("platform").isin(*platforms))
    per = offers.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(fee).alias("fee"), platform_order(F.col("platform")).alias("o"), F.col("platform")))).alias("s"))
    first, second = F.col("s")[0], F.try_element_at("s", F.lit(2))
    return per.select(key, first["platform"].alias("cheapest_platform"), first["fee"].alias("cheapest_fee"), F.coalesce(second["fee"] - first["fee"], F.lit(0)).alias("savings"), F.size("s").alias("offers"))


def fee_rows(listings: DataFrame, fee: str = "fee_cents", key: str = "restaurant_id") -> DataFrame:
    """Each known fee with its distance to the restaurant's least and whether it is that."""
    w = Window.partitionBy(key)
    order = w.orderBy(fee, platform_order(F.col("platform")))
    out = listings.where(F.col(fee).isNotNull())
    return out.withColumn("delta", F.col(fee) - F.min(fee).over(w)).withColumn("is_cheapest", F.row_number().over(order) == 1)


def quality_score(d: Column) -> Column:
    """A deal's score; a value or rating of 0 counts as none."""
    value, rated = F.coalesce(d["value"], F.lit(0.0)), F.coalesce(d["rating"], F.lit(0.0))
    by_kind = (
        F.when(d["promo_type"] == "pct_discount", value * 2)
        .when(d["promo_type"] == "abs_discount", value * 10)
        .when(d["promo_type"] == "free_delivery", 15.0)
        .when(d["promo_type"] == "bogo", 30.0)
        .when(d["promo_type"] == "free_item", 20.0)
        .otherwise(0.0)
    )
    return by_kind + rated * 2


def sort_deals(deals: DataFrame, mode: str = "best", tie: str = "id") -> DataFrame:
    score = quality_score(F.struct("promo_type", "value", "rating"))
    saving = F.when(F.col("promo_type").isin("pct_discount", "abs_discount"), F.coalesce("value", F.lit(0.0))).otherwise(0.0)
    by = {"best": [score.desc()], "newest": [F.col("scraped_at").desc()], "rated": [F.coalesce("rating", F.lit(0.0)).desc()], "saving": [saving.desc(), score.desc()]}
    return deals.orderBy(*by[mode], tie)


DEAL_KINDS = {"pct": "pct_discount", "abs": "abs_discount", "free_delivery": "free_delivery", "bogo": "bogo", "free_item": "free_item"}


def filter_deals(deals: DataFrame, kind: str = "all", platform: str = "all") -> DataFrame:
    out = deals if kind == "all" else deals.where(F.col("promo_type") == DEAL_KINDS[kind])
    return out if platform == "all" else out.where(F.col("platform") == platform)


def deal_counts(deals: DataFrame, platform: str = "all") -> DataFrame:
    return filter_deals(deals, "all", platform).agg(F.count("*").alias("all"), *[F.count_if(F.col("promo_type") == v).alias(k) for k, v in DEAL_KINDS.items()])


def listing_order(summary: DataFrame) -> DataFrame:
    """By coverage (half a point for a direct order link), chains last, then savings; the id ends every tie."""
    score = F.col("offers") + F.when(F.col("direct_url_type") == "ordering", 0.5).otherwise(0.0)
    return summary.orderBy(score.desc(), F.col("is_chain"), F.col("savings").desc(), "id")


def top_of_nearest(rows: DataFrame, distance: str, near: int, gain: str, top: int, tie: str) -> DataFrame:
    return rows.orderBy(distance, tie).limit(near).orderBy(F.col(gain).desc(), tie).limit(top)


def shelves(rows: DataFrame, measures: list[tuple[str, Column]], tie: str) -> DataFrame:
    """One restaurant for each measure in turn, none twice: the best that no shelf before has taken.

    Each shelf needs only as many leaders as there are shelves, so a few rows reach the last step.
    """
    spark = rows.sparkSession
    used: list = []
    out = []
    for name, measure in measures:
        best = rows.where(measure.isNotNull()).orderBy(measure.desc(), tie).limit(len(measures)).select(tie).collect()
        pick = next((r[0] for r in best if r[0] not in used), None)
        if pick is not None:
            used.append(pick)
            out.append((name, pick))
    kept = out if len(out) >= 2 else []
    return spark.createDataFrame(kept, f"shelf string, {tie} {dict(rows.dtypes)[tie]}")


def balanced_sample(rows: DataFrame, key: str, n: int, seed: int, tie: str) -> DataFrame:
    """n rows of each key in a seeded order that does not depend on partitions."""
    w = Window.partitionBy(key).orderBy(F.xxhash64(tie, F.lit(seed)), tie)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def priority_queue(rows: DataFrame, at: str, tie: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Never visited first, then the longest ago."""
    out = rows.orderBy(F.col(at).asc_nulls_first(), tie)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def feed_order(rows: DataFrame, mode: str = "cheapest") -> DataFrame:
    """Open first, the closed by their next opening; then platforms, a direct site, and the mode's own order; id ends ties.

    rows: closed_rank (hours.closed_rank), platform_count, direct_url_type, savings, eta_min, id.
    """
    inner = [F.coalesce("savings", F.lit(0)).desc()] if mode == "cheapest" else [F.col("eta_min").asc_nulls_last()]
    open_ = F.col("closed_rank") == 0
    return rows.orderBy("closed_rank", F.when(open_, -F.col("platform_count")).otherwise(0), F.when(open_ & F.col("direct_url_type").isNotNull(), 0).otherwise(1), *inner, "id")


def savings_examples(listings: DataFrame, least: int = 50, top: int = 5, key: str = "restaurant_id") -> DataFrame:
    """Restaurants with a direct listing whose two lowest fees differ enough, the widest first."""
    direct = listings.groupBy(key).agg(F.bool_or(F.col("platform") == "direct").alias("d"), F.count("*").alias("n")).where("d and n >= 2").select(key)
    best = cheapest(listings, key=key).where((F.col("offers") >= 2) & (F.col("savings") >= least))
    return best.join(direct, key, "left_semi").orderBy(F.col("savings").desc(), key).limit(top)


def best_saving(listings: DataFrame, key: str = "restaurant_id") -> DataFrame:
    """The restaurant that saves most, the first by id in a tie."""
    return cheapest(listings, key=key).where("savings > 0").orderBy(F.col("savings").desc(), key).limit(1)


def best_value(summary: DataFrame, top: int = 6) -> DataFrame:
    return summary.where("savings > 0").orderBy(F.col("savings").desc(), "id").limit(top)


def direct_winners(listings: DataFrame, key: str = "restaurant_id") -> DataFrame:
    return cheapest(listings, key=key).where("cheapest_platform = 'direct' and savings > 0")


def page(rows: DataFrame, column: str, value: str, least: int = 3) -> DataFrame:
    """Rows of a commune or cuisine by saving, none if there are too few."""
    own = rows.where(F.col(column) == value)
    n = own.agg(F.count("*").alias("_n"))
    return own.join(F.broadcast(n)).where(F.col("_n") >= least).drop("_n").orderBy(F.col("savings").desc(), "id")


def tiles(listings: DataFrame, key: str = "restaurant_id") -> DataFrame:
    """A card's listings as an array: direct first, then by fee, unknown fees last."""
    item = F.struct((F.col("platform") != "direct").alias("o"), F.coalesce("fee_cents", F.lit(2**31 - 1)).alias("f"), platform_order(F.col("platform")).alias("p"), F.col("platform"))
    return listings.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["platform"]).alias("tiles"))


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the order of zones and positions: an aggregate, so duplicates meet early."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_o"), F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *[F.col(f"_o.{c}") for c in order], *[F.col(f"_r.{c}") for c in rest])


def scan_page(dishes: DataFrame, page_: int = 0, size: int = 10) -> DataFrame:
    """Dishes by price spread, one page."""
    known = F.filter(F.array(*[F.col(p) for p in dims.PLATFORMS]), lambda x: x.isNotNull())
    out = dishes.withColumn("spread", F.array_max(known) - F.array_min(known)).where(F.size(known) >= 2)
    return out.orderBy(F.col("spread").desc(), "dish_key").offset(page_ * size).limit(size)
