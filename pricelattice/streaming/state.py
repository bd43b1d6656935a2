"""Stateful behaviour: current state from a stream of upserts, change log, sliding limits, canaries."""

from __future__ import annotations

import collections
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import mutate


def upsert_sink(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str], order: str, preserve: tuple[str, ...] = mutate.PRESERVED) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch is upserted into a snapshot that read() gives and write() replaces.

    The last row of a key in a batch counts; upserting a batch again changes nothing.
    """

    def sink(batch: DataFrame, _: int) -> None:
        write(mutate.upsert(read(), batch, keys, preserve, order))

    return sink


def change_log(updates: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """Rows whose values differ from the key's row before; the first row of a key is a change. Rows of one time stand in
    the order of their values."""
    w = Window.partitionBy(key).orderBy(at, *columns)
    now = F.struct(*columns)
    return updates.withColumn("_before", F.lag(now).over(w)).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(now)).drop("_before")


def sliding_limit(events: DataFrame, key: str, at: str, most: int = 10, seconds: int = 3600, tie: str | None = None) -> DataFrame:
    """Each event with how many its key has been allowed in the window up to it, and whether it is allowed too.

    What is refused does not count, so whether an event passes hangs on those before it: each key is one ordered scan
    that holds at most `most` times. Null times pass and count for nothing; `tie` orders events of one time.
    """

    def run(batches):
        now, kept = None, collections.deque()
        for batch in batches:
            counts, passes = [], []
            for k, t in zip(batch.column(key).to_pylist(), batch.column("_t").to_pylist(), strict=True):
                if (k,) != now:
                    now, kept = (k,), collections.deque()
                if t is None:
                    counts.append(0)
                    passes.append(True)
                    continue
                while kept and t - kept[0] > seconds * 1_000_000:
                    kept.popleft()
                counts.append(len(kept))
                passes.append(len(kept) < most)
                if passes[-1]:
                    kept.append(t)
            names = [c for c in batch.schema.names if c != "_t"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(counts, pa.int64()), pa.array(passes, pa.bool_())], [*names, "in_window", "allowed"])

    rows = events.drop("in_window", "allowed").withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "_t"), T.StructField("in_window", T.LongType()), T.StructField("allowed", T.BooleanType())])
    return rows.repartition(key).sortWithinPartitions(key, "_t", *([tie] if tie else [])).mapInArrow(run, schema)


def windowed_counts(events: DataFrame, key: str, at: str, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Counts by key and sliding window, for streams: late rows within the watermark are put in."""
    return events.withWatermark(at, late).groupBy(key, F.window(at, f"{seconds} seconds", f"{max(1, seconds // 6)} seconds")).count()


def canary(checks: DataFrame, run: str, at: str, blocked: str, least: int = 20, share: float = 0.35) -> DataFrame:
    """The first check at which a run's share of blocked checks is too high, where there is one; of one time, those that
    passed come first."""
    w = Window.partitionBy(run).orderBy(at, blocked).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = checks.withColumn("n", F.count("*").over(w)).withColumn("bad", F.sum(F.col(blocked).cast("int")).over(w))
    return seen.where((F.col("n") >= least) & (F.col("bad") / F.col("n") > share)).groupBy(run).agg(F.min(at).alias("abort_at"))
