"""Writes as functions of (old, delta) to new: upserts, replacements, merges, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An incoming null does not erase these.
PRESERVED = ("delivery_fee", "eta_min", "eta_max", "min_order", "rating", "review_count")
SNAPSHOT = ("delivery_fee", "eta_min", "eta_max", "min_order")


def upsert(old: DataFrame, delta: DataFrame, keys: list[str], preserve: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """old with delta's rows put in by key: delta's values win, but its nulls do not in `preserve`.

    Columns that delta lacks keep their old value. If delta may repeat a key, `order` names the column whose
    greatest row counts; of several such rows the greatest by its other columns.
    """
    if order:
        rest = [F.col(c).desc_nulls_last() for c, t in delta.dtypes if c not in (order, *keys) and not t.startswith("map")]
        w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *rest)
        delta = delta.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    o, d = old.withColumn("_old", F.lit(True)).alias("o"), delta.withColumn("_new", F.lit(True)).alias("d")
    joined = o.join(d, [F.col(f"o.{k}") == F.col(f"d.{k}") for k in keys], "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"d.{c}"))
        if c not in delta.columns:
            return F.col(f"o.{c}")
        if c in preserve:
            return F.coalesce(F.col(f"d.{c}"), F.col(f"o.{c}"))
        return F.when(F.col("_new"), F.col(f"d.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*[value(c).alias(c) for c in old.columns])


def snapshots(delta: DataFrame, at: Column) -> DataFrame:
    """History rows of listings in which any fee is known."""
    some = F.coalesce(*[F.col(c).cast("string") for c in SNAPSHOT]).isNotNull()
    return delta.where(some).select("listing_id", *SNAPSHOT, at.alias("captured_at"))


def replace_children(old: DataFrame, new: DataFrame, parent: str, touched: DataFrame | None = None) -> DataFrame:
    """All children of a touched parent give way to its new ones; touched names also parents that have none now."""
    keys = (touched if touched is not None else new).select(parent).distinct()
    return old.join(keys, parent, "left_anti").unionByName(new.select(*old.columns))


def fill_if_empty(rows: DataFrame, patch: DataFrame, key: str, columns: list[str], blank: tuple[str, ...] = ()) -> DataFrame:
    """Missing values from patch; in `blank` columns an empty text is missing too."""
    p = patch.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(p, F.col(key) == F.col("_k"), "left")
    for c in columns:
        old = F.nullif(F.col(c), F.lit("")) if c in blank else F.col(c)
        out = out.withColumn(c, F.coalesce(old, F.col(f"_{c}"), F.col(c)))
    return out.drop("_k", *[f"_{c}" for c in columns])


def patch_ranked(rows: DataFrame, patch: DataFrame, key: str, columns: list[str], rank) -> DataFrame:
    """Values from patch where its source ranks strictly higher; rank maps the source column to a number."""
    p = patch.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in [*columns, "geo_source"]])
    out = rows.join(p, F.col(key) == F.col("_k"), "left")
    wins = F.coalesce(rank(F.col("_geo_source")) > F.coalesce(rank(F.col("geo_source")), F.lit(-1)), F.lit(False))
    for c in [*columns, "geo_source"]:
        out = out.withColumn(f"_{c}", F.when(wins, F.col(f"_{c}")).otherwise(F.col(c)))
    names = [*columns, "geo_source"]
    return out.select(*[F.col(f"_{c}").alias(c) if c in names else F.col(c) for c in rows.columns])


FILLED = ("phone", "website", "lat", "lng", "geo_source", "cuisine", "image_url")


def merge_listings(listings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Listings of losers go to their survivors; of two on one platform the newer stays, the survivor's own in a tie.

    pairs: (survivor_id, loser_id), each loser once.
    """
    p = pairs.where("survivor_id <> loser_id").select("survivor_id", "loser_id")
    out = listings.join(p, F.col("restaurant_id") == F.col("loser_id"), "left")
    out = out.withColumn("_moved", F.col("survivor_id").isNotNull()).withColumn("restaurant_id", F.coalesce("survivor_id", "restaurant_id"))
    at = F.coalesce("last_scraped_at", F.timestamp_seconds(F.lit(0)))
    w = Window.partitionBy("restaurant_id", "platform").orderBy(at.desc(), F.col("_moved"), "id")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*listings.columns)


def merge_restaurants(restaurants: DataFrame, pairs: DataFrame, columns: tuple[str, ...] = FILLED) -> DataFrame:
    """Survivors with their losers' values where they have none; losers go."""
    p = pairs.where("survivor_id <> loser_id").select("survivor_id", "loser_id")
    have = [c for c in columns if c in restaurants.columns]
    lost = restaurants.join(p, F.col("id") == F.col("loser_id")).groupBy("survivor_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"_{c}") for c in have])
    out = restaurants.join(p.select(F.col("loser_id").alias("id")), "id", "left_anti").join(lost, F.col("id") == F.col("survivor_id"), "left")
    return out.select(*[F.coalesce(c, f"_{c}").alias(c) if c in have else F.col(c) for c in restaurants.columns])


def decide_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Decisions by unordered pair, the new ones in place of the old."""
    key = [F.least("survivor_id", "loser_id").alias("_a"), F.greatest("survivor_id", "loser_id").alias("_b")]
    o, n = old.select("*", *key), new.select("*", *key)
    return o.join(n.select("_a", "_b").distinct(), ["_a", "_b"], "left_anti").select(*old.columns).unionByName(n.select(*old.columns))


def expire(listings: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Listings seen within so many days."""
    seen = F.coalesce("last_scraped_at", "scraped_at")
    return listings.where(~F.coalesce(seen < as_of - F.make_dt_interval(F.lit(days)), F.lit(False)))


def prune_children(children: DataFrame, kept_parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return children.join(kept_parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def clean_up(listings: DataFrame, children: DataFrame, as_of: Column, days: int = 30, key: str = "id", parent: str = "listing_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The daily clean-up as one batch: the listings that stay, the children that do, and one row (deleted, pruned).

    Only children of expired listings go; those of listings that are unknown stay. Empty tables give counts of 0.
    """
    old = listings.where(F.coalesce(F.coalesce("last_scraped_at", "scraped_at") < as_of - F.make_dt_interval(F.lit(days)), F.lit(False)))
    gone = old.select(F.col(key).alias(parent)).distinct()
    zero = F.lit(0).cast("long")
    pruned = children.join(gone, parent, "left_semi").agg(zero.alias("deleted"), F.count("*").alias("pruned"))
    report = old.agg(F.count("*").alias("deleted"), zero.alias("pruned")).unionByName(pruned).agg(F.sum("deleted").alias("deleted"), F.sum("pruned").alias("pruned"))
    return expire(listings, as_of, days), children.join(gone, parent, "left_anti").select(*children.columns), report


def close_orphans(runs: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Runs that began long ago and never ended count as failed."""
    orphan = (F.col("status") == "running") & (F.col("started_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return runs.withColumn("status", F.when(orphan, "failed").otherwise(F.col("status"))).withColumn("finished_at", F.when(orphan, as_of).otherwise(F.col("finished_at")))


def run_state(events: DataFrame) -> DataFrame:
    """The last event of each run, with the last known value of what it leaves out."""
    w = Window.partitionBy("run_id").orderBy("at", *(c for c in events.columns if c not in ("run_id", "at")))
    known = [F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(c) for c in events.columns if c not in ("run_id", "at")]
    return events.select("run_id", F.max("at").over(Window.partitionBy("run_id")).alias("at"), *known).distinct()


def clean_links(rows: DataFrame, column: str, junk) -> DataFrame:
    return rows.withColumn(column, F.when(~junk(F.col(column)), F.col(column)))


def claim_errors(claims: DataFrame) -> DataFrame:
    """Claims that break a rule: an address without form, or neither a restaurant nor a free name."""
    mail = F.coalesce(F.col("owner_email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False))
    return claims.where(~mail | (F.col("restaurant_id").isNull() & F.col("restaurant_name_free").isNull()))


def settle_claims(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """verdicts (id, approve): approved claims are verified, rejected ones go."""
    v = verdicts.select(F.col("id"), F.col("approve").alias("_v"))
    out = claims.join(v, "id", "left").where(F.col("_v").isNull() | F.col("_v"))
    return out.withColumn("verified", F.coalesce("_v", "verified")).select(*claims.columns)


def resolve_decisions(decisions: DataFrame, resolved: DataFrame, at: Column) -> DataFrame:
    """resolved (id, status, resolved_by) put in; decisions without a loser go."""
    r = resolved.select("id", F.col("status").alias("_s"), F.col("resolved_by").alias("_by"))
    out = decisions.where("loser_id is not null").join(r, "id", "left")
    hit = F.col("_s").isNotNull()
    changed = {"status": F.coalesce("_s", "status"), "resolved_by": F.coalesce("_by", "resolved_by"), "resolved_at": F.when(hit, at).otherwise(F.col("resolved_at"))}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in decisions.columns])


def prune_queue(decisions: DataFrame, rescored: DataFrame) -> DataFrame:
    """Queued decisions whose pair (survivor_id, loser_id) is not `separate` by now."""
    apart = rescored.where("decision = 'separate'").select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"))
    key = decisions.withColumn("_a", F.least("survivor_id", "loser_id")).withColumn("_b", F.greatest("survivor_id", "loser_id"))
    gone = key.where("status = 'queued'").join(apart, ["_a", "_b"], "left_semi").select("id")
    return decisions.where("loser_id is not null").join(gone, "id", "left_anti")


def raise_chains(restaurants: DataFrame, tokens: DataFrame, token: Column) -> DataFrame:
    """is_chain set where the name's first word is a chain's; never unset."""
    t = tokens.select(F.col("token").alias("_t")).distinct().withColumn("_hit", F.lit(True))
    out = restaurants.withColumn("_k", token).join(t, F.col("_k") == F.col("_t"), "left")
    return out.withColumn("is_chain", F.coalesce("is_chain", F.lit(False)) | F.coalesce("_hit", F.lit(False))).select(*restaurants.columns)


def direct_listings(restaurants: DataFrame, at: Column, kind) -> DataFrame:
    """A direct listing of each restaurant that has an order link; kind gives its type from link and phone."""
    own = restaurants.where(F.col("order_url").isNotNull())
    return own.select(F.col("id").alias("restaurant_id"), F.lit("direct").alias("platform"), F.col("order_url").alias("url"), kind(F.col("order_url"), F.col("phone")).alias("url_type"), F.lit(True).alias("is_available"), at.alias("last_scraped_at"))


def reload(rows: DataFrame, path: str, keys: list[str], blank: tuple[str, ...] = ()) -> None:
    """A table replaced as a whole: empty texts become null, a key stands once."""
    out = rows
    for c in blank:
        out = out.withColumn(c, F.nullif(F.trim(c), F.lit("")))
    out.dropDuplicates(keys).write.mode("overwrite").parquet(path)


def write_report(scored: DataFrame, path: str) -> None:
    """A dry run's pairs as JSON, the highest score first."""
    scored.orderBy(F.col("total").desc(), "a", "b").write.mode("overwrite").json(path)
