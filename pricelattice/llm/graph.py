"""Connected components of an edge table, in rounds of joins; nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work


def _print(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, work: Work) -> DataFrame:
    """edges (a, b) to (node, label): label is the smallest node of the component.

    Each round every node hangs its larger neighbours on its smallest one (large star), then its smaller neighbours
    too (small star); rounds end when nothing changes, in about the logarithm of the longest path. A hot node is a
    sum by key first and one side of a join after, which the adaptive planner can split. Self-loops and repeated
    edges change nothing; nodes without an edge are not returned; an empty table gives an empty one.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = work.table(e, "edges")
    seen = _print(e)
    while seen[0]:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = work.table(hung.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = _print(e)
        if now == seen:
            break
        seen = now
    roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("label"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(roots)
