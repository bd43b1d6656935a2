"""The driver's tables seen as merchants, listings, runs and deals, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(rows: DataFrame, at: str) -> Column:
    """The greatest time in the table, as a literal: one value reaches the driver."""
    value = rows.agg(F.max(at).cast("string")).first()[0]
    return F.lit(value).cast(dict(rows.dtypes)[at])


def platform(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in dims.PLATFORMS]), (c % 4 + 1).cast("int"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures: line items as listings of parts on four platforms."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_partkey").alias("restaurant_id"),
        platform(F.col("l_suppkey")).alias("platform"),
        F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("int").alias("fee_cents"),
        F.col("l_shipdate").alias("last_scraped_at"),
        F.col("l_quantity").cast("int").alias("eta_min"),
        F.col("l_returnflag").alias("flag"),
    )


def newest(rows: DataFrame, keys: list[str], at: str, tie: str, fixed: list[str], letters: tuple[str, ...] = ()) -> DataFrame:
    """The newest row of each key: its time and tie packed into one decimal that every column is the greatest by.

    Only columns of fixed width (`fixed`, and texts of one letter as their codes) are buffers that a hash aggregate can
    hold, so rows combine before the shuffle and nothing is sorted. tie is a long, not negative, one for each row.
    """
    order = F.unix_micros(F.col(at).cast("timestamp")).cast("decimal(38,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col(tie)
    r = rows.withColumn("_o", order.cast("decimal(38,0)"))
    by = [F.max_by(c, "_o").alias(c) for c in (at, tie, *fixed)] + [F.max_by(F.ascii(c), "_o").alias(c) for c in letters]
    out = r.groupBy(*keys).agg(*by)
    return out.select(*[F.char(c).alias(c) if c in letters else F.col(c) for c in out.columns])


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest capture of each (restaurant, platform)."""
    return newest(offers(spark, sf_dir), ["restaurant_id", "platform"], "last_scraped_at", "id", ["fee_cents", "eta_min"], ("flag",))


OFFERS = """o AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS restaurant_id, ['uber_eats', 'deliveroo', 'takeaway', 'direct'][(l_suppkey % 4 + 1)::INT] AS platform,
  floor(l_extendedprice * 100 + 0.5)::INT AS fee_cents, l_shipdate AS last_scraped_at, l_quantity::INT AS eta_min, l_returnflag AS flag FROM lineitem)"""
LISTINGS = OFFERS + """, l AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id, platform ORDER BY last_scraped_at DESC, id DESC) AS rn FROM o) WHERE rn = 1)"""
FRESH = LISTINGS + """, f AS (SELECT * FROM l WHERE last_scraped_at > (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 365 DAY)"""
ORDER = "list_position(['uber_eats', 'deliveroo', 'takeaway', 'direct'], platform)"


def restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("cuisine"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as points around a city."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (50.85 + 0.1 * F.col("embedding")[0].cast("double")).alias("lat"), (4.35 + 0.1 * F.col("embedding")[1].cast("double")).alias("lng"))


PLACES = "p AS (SELECT vec_id AS id, 50.85 + 0.1 * embedding[1]::DOUBLE AS lat, 4.35 + 0.1 * embedding[2]::DOUBLE AS lng FROM embeddings)"
HAVERSINE = "6371000.0 * 2 * asin(least(1.0, sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lng) - radians({a}.lng)) / 2), 2))))"

KINDS = ("free_delivery", "bogo", "pct_discount", "abs_discount", "free_item")


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as promotions, seen for ranking only."""
    e = read(spark, sf_dir, "events")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), platform(F.col("user_id")).alias("platform"), kind.alias("promo_type"), F.col("value"), (F.col("user_id") % 6).cast("double").alias("rating"), F.col("ts").alias("scraped_at"))


DEALS = """d AS (SELECT event_id AS id, ['uber_eats', 'deliveroo', 'takeaway', 'direct'][(user_id % 4 + 1)::INT] AS platform,
  ['free_delivery', 'bogo', 'pct_discount', 'abs_discount', 'free_item'][(event_id % 5 + 1)::INT] AS promo_type, value, (user_id % 6)::DOUBLE AS rating, ts AS scraped_at FROM events),
s AS (SELECT *, CASE promo_type WHEN 'pct_discount' THEN coalesce(value, 0.0) * 2 WHEN 'abs_discount' THEN coalesce(value, 0.0) * 10 WHEN 'free_delivery' THEN 15.0 WHEN 'bogo' THEN 30.0 WHEN 'free_item' THEN 20.0 ELSE 0.0 END + coalesce(rating, 0.0) * 2 AS score FROM d)"""


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    """A table of cases for SQL."""
    def literal(v):
        if v is None:
            return "NULL"
        return repr(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).upper() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"

    return f"{name}({', '.join(columns)}) AS (VALUES " + ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows) + ")"
