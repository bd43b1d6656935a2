"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, table

#: A source table up to this many rows is broadcast; a larger one is joined by key.
BROADCAST_SOURCES = 100_000
#: Seeded order of documents: 60 bits of a digest, of which the first 12 name a bucket.
ORDER_BITS, BUCKET_BITS = 60, 12


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_order(key: str, seed: str):
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, ORDER_BITS // 4), 16, 10).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """(source, source_size) to targets: weights by rank of the source (code points, null last), repeating.

    All targets share `share` of all sizes; each stops at `epochs` times its source and what is over goes to the rest
    by weight until none is above. The sorted order of cap/weight gives that fixed point without rounds: the sources
    that stop are a prefix. One row per source stands in one task; rows of documents never do.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % F.lit(len(weights)) + 1).cast("int"))
    t = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    t = t.withColumn("cap", F.lit(float(epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("k", F.row_number().over(by_ratio))
    t = t.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    free = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("k", "level"))).over(everything)
    t = t.withColumn("free", free)
    target = F.when(F.col("free").isNull() | (F.col("k") < F.col("free.k")), F.col("cap")).otherwise(F.least("cap", F.col("free.level") * F.col("weight")))
    return t.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: str = "mix", key: str = "doc_id", work: Work | None = None) -> tuple[DataFrame, DataFrame]:
    """(sized documents, one row per source) for take_mix().

    A source's target is `whole` repetitions of all its documents and a fractional one: its documents in seeded order,
    each whole, until the words that are left end inside one document. Sums by (source, bucket of the order) find the
    bucket where that is; only that bucket's documents are ordered. Null or empty texts have size 0; a null source is
    a source; rows that repeat a key stand at one place of the order and share what is left there.
    """
    work = work or Work(docs.sparkSession, "mix")
    sized = work.table(docs.select(F.col(key), "source", word_count().alias("size"), seeded_order(key, seed).alias("_h")), "sized")
    sums = work.table(sized.groupBy("source", F.shiftright("_h", ORDER_BITS - BUCKET_BITS).alias("bucket")).agg(F.sum("size").alias("n")), "sums")
    plan = water_fill(sums.groupBy("source").agg(F.sum("n").alias("source_size")), tuple(weights), share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("left", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"))
    plan = work.table(plan, "targets")
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    run = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    cut = run.join(plan.select("source", "left"), same(run, plan)).where("before <= left and left < before + n").select(run["source"], "bucket", (F.col("left") - F.col("before")).alias("left"))
    cut = work.table(cut, "cuts")
    near = sized.withColumn("bucket", F.shiftright("_h", ORDER_BITS - BUCKET_BITS))
    near = near.join(_small(cut), near["source"].eqNullSafe(cut["source"]) & (near["bucket"] == cut["bucket"])).select(near["source"], "_h", F.col(key), "size", "left")
    near = near.groupBy("source", "_h", key).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.first("left").alias("left"))
    within = Window.partitionBy("source").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).where("before <= left and left < before + n")
    near = near.select("source", F.col("_h").alias("cut_h"), F.col(key).alias("cut_key"), F.floor((F.col("left") - F.col("before")) / F.col("rows")).cast("long").alias("cut_words"))
    return sized, work.table(plan.join(near, same(plan, near), "left").select(plan["source"], "source_size", "weight", "target", "whole", "left", "cut_h", "cut_key", "cut_words"), "plan")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else df


def take_mix(docs: DataFrame, plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs (with source, size, _h) with source_size, target, whole (repetitions) and extra (words of the fractional one)."""
    p = _small(plan.withColumnRenamed("source", "_source"))
    j = docs.join(p, docs["source"].eqNullSafe(p["_source"])).drop("_source")
    here = F.coalesce(F.col(key).cast("string"), F.lit("")) == F.coalesce(F.col("cut_key").cast("string"), F.lit(""))
    first = F.col(key).isNull() | (F.col(key) < F.col("cut_key"))
    extra = (
        F.when(F.col("cut_h").isNull(), F.when(F.col("left") > 0, F.col("size")).otherwise(0))
        .when((F.col("_h") == F.col("cut_h")) & here, F.least("size", "cut_words"))
        .when((F.col("_h") < F.col("cut_h")) | ((F.col("_h") == F.col("cut_h")) & first), F.col("size"))
        .otherwise(0)
    )
    return j.withColumn("extra", extra.cast("long")).drop("left", "cut_h", "cut_key", "cut_words")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as its source repeats it.

    Documents come whole: the one in which a source's words end comes if at least half of it belongs to the mix.
    """
    key = how.get("key", "doc_id")
    names = docs.columns
    _, plan = mix_plan(docs, **how)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(key), "source", word_count().alias("size"), seeded_order(key, how.get("seed", "mix")).alias("_h"))
    rows = take_mix(rows, plan, key)
    more = F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size")), 1).otherwise(0)
    rows = rows.withColumn("_n", (F.col("whole") + more).cast("int")).where("_n > 0")
    return rows.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).select(*[F.col(f"_doc.`{c}`").alias(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    sized, plan = mix_plan(table(spark, sf_dir, "documents"))
    out = take_mix(sized, plan)
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM src),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM ranked),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS k,
        (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min(k) AS k FROM o WHERE level < cap / weight),
t AS (SELECT source, source_size, CASE WHEN f.k IS NULL OR o.k < f.k THEN cap ELSE least(cap, (SELECT level FROM o o2 WHERE o2.k = f.k) * weight) END AS target FROM o, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
d AS (SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, floor(p.target + 0.5)::BIGINT - p.whole * p.source_size AS left_words,
        coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM sized s JOIN p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, left_words - before)))::BIGINT AS taken FROM d
"""
