"""Relational reads: fresh joins, nested aggregates, radius, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def fresh(listings: DataFrame, as_of: Column, hours: int = 72, at: str = "last_scraped_at") -> DataFrame:
    return listings.where(F.col(at) > as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def visible(restaurants: DataFrame, placed: bool = False) -> DataFrame:
    out = restaurants.where("merged_into is null and exclude_reason is null")
    return out.where("lat is not null and lng is not null") if placed else out


def with_listings(restaurants: DataFrame, listings: DataFrame, fields: list[str], key: str = "restaurant_id") -> DataFrame:
    """Each restaurant with the array of its listings, ordered by fields, empty if it has none; and its platform count.

    The listings are aggregated before the join, so the join's right side has a row for each restaurant.
    """
    per = listings.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("platform_listings"), F.countDistinct("platform").alias("platform_count"))
    empty = F.filter("platform_listings", lambda _: F.lit(False))
    out = restaurants.join(per.withColumnRenamed(key, "_id"), F.col("id") == F.col("_id"), "left").drop("_id")
    out = out.withColumn("platform_count", F.coalesce("platform_count", F.lit(0)))
    return out.withColumn("platform_listings", F.coalesce("platform_listings", empty, F.from_json(F.lit("[]"), per.schema["platform_listings"].dataType)))


def nested_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, fields: list[str], name: str) -> DataFrame:
    """parents with the ordered array of their children's fields."""
    per = children.groupBy(F.col(child_key).alias("_k")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    out = parents.join(per, F.col(parent_key) == F.col("_k"), "left").drop("_k")
    return out.withColumn(name, F.coalesce(name, F.from_json(F.lit("[]"), per.schema[name].dataType)))


def comparable(listings: DataFrame, least: int = 2, key: str = "restaurant_id") -> DataFrame:
    """Restaurants on at least so many platforms."""
    return listings.groupBy(key).agg(F.countDistinct("platform").alias("platform_count")).where(F.col("platform_count") >= least)


def flag_exists(rows: DataFrame, key: str, other: DataFrame, other_key: str, name: str) -> DataFrame:
    """A boolean: does other have the key? One row for each key on the right, so no row is repeated."""
    keys = other.select(F.col(other_key).alias("_k")).where("_k is not null").distinct().withColumn("_hit", F.lit(True))
    return rows.join(keys, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")


def first_by_rank(rows: DataFrame, key: str, value: str, rank: Column, tie: str) -> DataFrame:
    """For each key the value of least rank; a correlated scalar lookup as one aggregate."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct(rank.alias("r"), F.col(tie).alias("t"))).alias(value))


def within_radius(rows: DataFrame, lat: float, lng: float, km: float) -> DataFrame:
    """Rows up to km away, nearest first. A box that holds the circle is tested first and reaches the scan."""
    import math

    dy = math.degrees(km / 6371.0) * 1.001
    dx = dy / max(0.01, math.cos(math.radians(min(89.0, abs(lat) + dy))))
    box = rows.where(F.col("lat").between(lat - dy, lat + dy) & F.col("lng").between(lng - dx, lng + dx))
    return box.withColumn("distance_km", geo.cosine_km(F.col("lat"), F.col("lng"), lat, lng)).where(F.col("distance_km") <= km)


def stale_or_missing(restaurants: DataFrame, listings: DataFrame, as_of: Column, days: int = 10) -> DataFrame:
    """Restaurants whose direct listing is absent or old."""
    at = listings.where("platform = 'direct'").groupBy("restaurant_id").agg(F.max("last_scraped_at").alias("_at"))
    out = restaurants.join(at, F.col("id") == F.col("restaurant_id"), "left")
    return out.where(F.col("_at").isNull() | (F.col("_at") < as_of - F.make_dt_interval(F.lit(days)))).drop("_at", "restaurant_id")


def only_on_one(listings: DataFrame) -> DataFrame:
    """Restaurants on exactly one platform, with it."""
    per = listings.groupBy("restaurant_id").agg(F.sort_array(F.collect_set("platform")).alias("platforms"))
    return per.where(F.size("platforms") == 1).select("restaurant_id", F.element_at("platforms", 1).alias("platform"))


def missing(listings: DataFrame, platforms: tuple[str, ...]) -> DataFrame:
    """A row for each restaurant and platform that it is not on."""
    per = listings.groupBy("restaurant_id").agg(F.collect_set("platform").alias("on"))
    every = F.array(*[F.lit(p) for p in platforms])
    return per.select("restaurant_id", F.explode(F.array_except(every, F.col("on"))).alias("missing_platform"))


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stale_runs(runs: DataFrame, as_of: Column, hours: int = 25) -> DataFrame:
    """The last success of each platform, its age in seconds and whether that is too old."""
    ok = runs.where("status = 'success'").groupBy("platform").agg(F.max("finished_at").alias("finished_at"))
    age = F.timestamp_diff("SECOND", F.col("finished_at"), as_of)
    return ok.withColumn("age_s", age).withColumn("stale", age > hours * 3600)


def search(rows: DataFrame, needle: str = "", neighborhood: str | None = None, cuisine: str | None = None) -> DataFrame:
    """Rows whose name holds the needle, case aside, in a neighbourhood and of a cuisine if given."""
    out = rows.where(F.contains(F.lower("name"), F.lit(needle.lower()))) if needle else rows
    out = out.where(F.col("neighborhood") == neighborhood) if neighborhood else out
    return out.where(F.col("cuisine") == cuisine) if cuisine else out


def by_category(items: DataFrame, needle: str = "", key: str = "restaurant_id") -> DataFrame:
    """A menu's items under their category, "Other" for none."""
    found = items.where(F.contains(F.lower("title"), F.lit(needle.lower()))) if needle else items
    return found.groupBy(key, F.coalesce("category", F.lit("Other")).alias("category")).agg(F.sort_array(F.collect_list("title")).alias("titles"))


def facets(rows: DataFrame, column: str, least: int = 1) -> DataFrame:
    """Values with their counts, the most frequent first."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), column)


def first_values(rows: DataFrame, column: str, n: int = 8) -> DataFrame:
    return rows.where(F.coalesce(F.col(column), F.lit("")) != "").select(column).distinct().orderBy(column).limit(n)


def run_metrics(samples: DataFrame, key: str = "run_id") -> DataFrame:
    """Peak and mean memory of each run in whole megabytes, and its counters."""
    return samples.groupBy(key).agg(F.max("ram_mb").alias("ram_peak"), F.floor(geo.exact_mean(F.col("ram_mb"))).alias("ram_avg"), F.sum("errors").alias("errors"), F.count("*").alias("samples"))


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Counts of each value and their share of all; the total is one row, joined, so no row is gathered."""
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def extremes(listings: DataFrame, key: str = "restaurant_id") -> DataFrame:
    return listings.groupBy(key).agg(F.min("last_scraped_at").alias("oldest"), F.max("last_scraped_at").alias("newest"), F.min("eta_min").alias("fastest"))


def review_queue(decisions: DataFrame, listings: DataFrame, fields: list[str]) -> DataFrame:
    """Open decisions with the listings of both sides; listings are aggregated once."""
    per = listings.groupBy("restaurant_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("l"))
    out = decisions.where("status = 'queued'")
    for side in ("survivor", "loser"):
        out = out.join(per.select(F.col("restaurant_id").alias(f"{side}_id"), F.col("l").alias(f"{side}_listings")), f"{side}_id", "left")
    return out


def detail(restaurants: DataFrame, key: str) -> DataFrame:
    """One restaurant by identifier, else by slug."""
    import re

    form = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    return restaurants.where(F.col("id" if re.fullmatch(form, key) else "slug") == key).limit(1)


def pending(applied: DataFrame, available: DataFrame, name: str = "name") -> DataFrame:
    """What is available and not applied yet, in order."""
    return available.join(applied.select(name), name, "left_anti").orderBy(name)
