"""Event streams: filters, windows, sessions, debounce, storms; the same operators on batches where they make sense."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..session import cut, ensure_checkpoint_dir, shuffle_width


def trailing_counts(events: DataFrame, seconds: int = fixed.STORM_WINDOW_S) -> DataFrame:
    """events(event_id, ts) -> with n: events in the trailing window up to and with each one.

    Time is cut into buckets of the window's length; a bucket's events are also shown to the next one, so that every
    window is whole inside one partition and nothing is gathered in a single task.
    """
    e = events.select("event_id", F.col("ts").cast("timestamp").alias("ts")).where("ts is not null")
    e = e.withColumn("_us", F.unix_micros("ts")).withColumn("_b", F.floor(F.col("_us") / (seconds * 1_000_000)))
    shown = e.withColumn("_own", F.lit(True)).unionByName(e.withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False)))
    w = Window.partitionBy("_b").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    return shown.withColumn("n", F.count("*").over(w)).where("_own").select("event_id", "ts", "n")


def islands(events: DataFrame, by: str, seconds: float) -> DataFrame:
    """events(event_id, by, ts) -> event_id, _k, _us, island: a gap of ``seconds`` or more, or another key, begins a new island.

    Rows are range-partitioned by (key, time), so a hot key is spread over many tasks; each partition counts its own
    breaks, and what crosses partitions is one summary row each, which the driver adds up.
    """
    gap = int(seconds * 1_000_000)
    e = events.where(f"{by} is not null and ts is not null").select("event_id", F.col(by).cast("string").alias("_k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"))
    spark = e.sparkSession
    placed = cut(e.repartitionByRange(max(shuffle_width(spark), spark.sparkContext.defaultParallelism), "_k", "_us", "event_id").sortWithinPartitions("_k", "_us", "event_id")).withColumn("_p", F.spark_partition_id())

    def breaks(k: np.ndarray, us: np.ndarray, before: tuple | None) -> np.ndarray:
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (us[1:] - us[:-1] >= gap)
        if before is not None and len(k):
            new[0] = k[0] != before[0] or us[0] - before[1] >= gap
        return new

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last, n, pid = None, None, 0, 0
        for b in batches:
            if not len(b):
                continue
            k, us = b["_k"].to_numpy(), b["_us"].to_numpy()
            pid = int(b["_p"].iloc[0])
            new = breaks(k, us, last)
            n += int(new.sum()) - (1 if first is None else 0)
            first = first or (k[0], int(us[0]))
            last = (k[-1], int(us[-1]))
        if first:
            yield pd.DataFrame({"p": [pid], "k0": [first[0]], "u0": [first[1]], "k1": [last[0]], "u1": [last[1]], "n": [n]})

    rows = sorted(placed.mapInPandas(summary, "p int, k0 string, u0 bigint, k1 string, u1 bigint, n bigint").collect(), key=lambda r: r.p)  # a row per partition
    start: dict[int, int] = {}
    at, before = 0, None
    for r in rows:
        begins = before is None or r.k0 != before.k1 or r.u0 - before.u1 >= gap
        at += 1 if begins else 0
        start[r.p] = at
        at += r.n
        before = r
    given = spark.sparkContext.broadcast(start)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, at = None, None
        for b in batches:
            if not len(b):
                continue
            k, us = b["_k"].to_numpy(), b["_us"].to_numpy()
            new = breaks(k, us, last).astype(np.int64)
            if at is None:
                at = given.value[int(b["_p"].iloc[0])]
                new[0] = 0
            island = at + np.cumsum(new)
            at, last = int(island[-1]), (k[-1], int(us[-1]))
            yield pd.DataFrame({"event_id": b["event_id"], "_k": k, "_us": us, "island": island})

    return placed.mapInPandas(number, "event_id bigint, _k string, _us bigint, island bigint")


def _in_islands(events: DataFrame, by: str, seconds: float, fold: Callable) -> DataFrame:
    """Runs an ordered fold over every island; only the fold's own state is held."""
    return islands(events, by, seconds).repartition("island").sortWithinPartitions("island", "_us", "event_id").mapInPandas(fold, "event_id bigint, _k string, _us bigint")


def debounce(events: DataFrame, by: str, seconds: float = fixed.DEBOUNCE_S) -> DataFrame:
    """events(event_id, by, ts): drops an event less than ``seconds`` after the last *accepted* one of its key.

    An event after a gap of that length is always accepted, so islands between such gaps are folded on their own.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, last = None, None
        for b in batches:
            keep = []
            for i, us in zip(b["island"], b["_us"]):
                if i != island:
                    island, last = i, None
                ok = last is None or us - last >= seconds * 1_000_000
                keep.append(ok)
                last = us if ok else last
            yield b.loc[keep, ["event_id", "_k", "_us"]]

    return _in_islands(events, by, seconds, fold).select("event_id", F.col("_k").alias(by), F.timestamp_micros("_us").alias("ts"))


def storm_pauses(events: DataFrame, seconds: int = fixed.STORM_WINDOW_S, threshold: int = fixed.STORM_THRESHOLD, cooldown: float = 8.0) -> DataFrame:
    """(event_id, ts) of the events that begin a pause: the window holds ``threshold`` events and no pause is on.

    A pause lasts ``cooldown`` seconds; storms further apart than that don't depend on each other.
    """
    hot = trailing_counts(events, seconds).where(F.col("n") >= threshold).withColumn("all", F.lit("all"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, until = None, None
        for b in batches:
            keep = []
            for i, us in zip(b["island"], b["_us"]):
                if i != island:
                    island, until = i, None
                ok = until is None or us >= until
                keep.append(ok)
                until = us + int(cooldown * 1_000_000) if ok else until
            yield b.loc[keep, ["event_id", "_k", "_us"]]

    return _in_islands(hot, "all", cooldown, fold).select("event_id", F.timestamp_micros("_us").alias("ts"))


def sessions(events: DataFrame, by: str, seconds: float) -> DataFrame:
    """One row per burst: a gap of that length or more begins a new one. Bursts are counted by partial aggregation."""
    g = islands(events, by, seconds).groupBy("island").agg(F.min("_k").alias(by), F.min("_us").alias("us"), F.count("*").alias("n_events"))
    return g.select(by, F.timestamp_micros("us").alias("start_ts"), "n_events")


def changes(states: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before; the first observation is a baseline, not a change."""
    w = Window.partitionBy(by).orderBy(order)
    return states.withColumn("before", F.lag(value).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A file source over Parquet; with ``availableNow`` it ends when all files are read."""
    return spark.readStream.schema(schema).parquet(folder)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and gives its result; state and offsets lie in the shared folder."""
    spark = stream.sparkSession
    import uuid

    at = f"{ensure_checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    out = f"{at}/out"
    if mode == "append":
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/ck").option("path", out).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def debounce_stream(events: DataFrame, by: str, seconds: float = fixed.DEBOUNCE_S) -> DataFrame:
    """The debounce on a stream: state is the last accepted time of each key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        keep = []
        for us in rows["us"]:
            ok = last is None or us - last >= seconds * 1_000_000
            keep.append(ok)
            last = us if ok else last
        state.update((int(last),))
        yield rows.loc[keep, ["event_id", by, "us"]]

    e = events.where(f"{by} is not null").select("event_id", F.col(by).cast("string").alias(by), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return e.groupBy(by).applyInPandasWithState(step, f"event_id bigint, {by} string, us bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def session_stream(events: DataFrame, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Bursts on a stream, given out when the watermark has passed them."""
    g = events.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events"))
    return g.select(by, F.col("s.start").alias("start_ts"), "n_events")


def upsert_stream(stream: DataFrame, target: str, keys: list[str], name: str) -> DataFrame:
    """Per micro-batch: rows of the batch's keys are replaced in a table of versions; gives the last version.

    Every batch writes a new version folder and then its number, so readers never see half a batch.
    """
    from ..sources.store import VersionedTable

    store = VersionedTable(stream.sparkSession, target)

    def merge(batch: DataFrame, n: int) -> None:
        fresh = batch.dropDuplicates(keys)
        old = store.read()
        store.write(fresh if old is None else old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh), f"batch-{n}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{target}-ck-{name}").trigger(availableNow=True).start().awaitTermination()
    return store.read()
