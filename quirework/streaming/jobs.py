"""Structured Streaming forms of intake, run statistics, recent files, batch
progress and sessions.  Every function maps a streaming DataFrame to one, or
starts a query whose sink is a table folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quirework.operators import files as file_ops
from quirework.operators.runs import latest, run_stats
from quirework.session import remove_folder, shared_dir
from quirework.sources.readers import manifest

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def intake(spark: SparkSession, path: str, glob: str = "*", content: bool = True) -> DataFrame:
    """Stream of new files; stateless, so it scales with the arriving files."""
    raw = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", 1000)
        .load(path)
    )
    return manifest(raw, content)


def intake_errors(files: DataFrame) -> DataFrame:
    """Error rows of rule and structure checks over the intake stream."""
    return file_ops.validate_files(files).unionByName(file_ops.validate_structure(files))


def run_stats_windows(runs: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Run statistics per event-time window; rows later than the mark are dropped."""
    marked = runs.withWatermark("start_ts", late).withColumn(
        "w", F.window("start_ts", width, slide) if slide else F.window("start_ts", width)
    )
    return run_stats(marked, "w").select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "total", "completed", "failed", "cancelled", "avg_duration", "success_rate",
    )


def batch_progress(updates: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts per batch and state from progress updates, repeats removed within the mark."""
    return (
        updates.withWatermark("ts", late)
        .dropDuplicatesWithinWatermark(["update_id"])
        .groupBy(F.window("ts", "1 day").alias("w"), "status")
        .agg(F.count("*").alias("n"), F.sum("progress").alias("progress_sum"))
        .select(F.col("w.start").alias("window_start"), "status", "n", "progress_sum")
    )


def user_sessions(runs: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user over run events."""
    return (
        runs.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("s"))
        .agg(F.count("*").alias("n_runs"))
        .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_runs")
    )


def keep_latest(
    stream: DataFrame, path: str, key: list[str], ts: str, tie: str, checkpoint: str, fold_every: int = 16
) -> StreamingQuery:
    """Maintain the newest row per key in a table folder; :func:`read_latest` reads it.

    A batch writes one row for each of its own keys and nothing else.  Every
    ``fold_every``-th batch also takes in what was written since the last such
    batch, itself included, and folders older than that are deleted.  A replayed
    batch rewrites its own folder from folders that are still there.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        fresh = latest(batch, key, ts, tie)
        if epoch and (epoch + 1) % fold_every == 0:
            earlier = [f"{path}/v={v}" for v in range(max(0, epoch - fold_every), epoch)]
            fresh = latest(fresh.unionByName(spark.read.schema(fresh.schema).parquet(*earlier)), key, ts, tie)
        fresh.write.mode("overwrite").parquet(f"{path}/v={epoch}")
        if (epoch + 1) % fold_every == 0:
            for v in range(max(0, epoch - 2 * fold_every), epoch - fold_every):
                remove_folder(spark, f"{path}/v={v}")

    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, path: str, key: list[str], ts: str, tie: str) -> DataFrame:
    """The newest row per key over the folders of :func:`keep_latest`; a row seen in several of them counts once."""
    return latest(spark.read.parquet(path).drop("v"), key, ts, tie)


class NewestRows(StatefulProcessor):
    """State of one key: its ``n`` newest items, newest first, and the number of the last change.

    An item that leaves the list cannot come back by a row that is older than the list, so nothing else has to be kept.
    With ``idle`` a key whose newest row lies that many milliseconds of event time back is let go by a timer.
    """

    ITEM = "item string, ts timestamp, id long"

    def __init__(self, key: str, n: int, idle: int | None):
        self.key, self.n, self.idle = key, n, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.items, self.version = handle.getListState("items", self.ITEM), handle.getValueState("version", "v long")

    def _held(self) -> dict:
        return {item: (ts, id_) for item, ts, id_ in self.items.get()} if self.items.exists() else {}

    def _changes(self, key, before: dict, after: dict):
        rows = [(item, *after[item], True) for item in after if before.get(item) != after[item]]
        rows += [(item, *before[item], False) for item in before if item not in after]
        if rows:
            version = self.version.get()[0] + 1 if self.version.exists() else 1
            self.version.update((version,))
            item, ts, id_, kept = zip(*rows, strict=True)
            yield pd.DataFrame({self.key: [key[0]] * len(rows), "item": item, "ts": ts, "id": id_, "version": [version] * len(rows), "kept": kept})

    def handleInputRows(self, key, rows, timerValues):
        before = self._held()
        now = dict(before)
        for pdf in rows:
            for item, ts, id_ in zip(pdf["item"], pdf["ts"].dt.to_pydatetime(), pdf["id"].tolist(), strict=True):
                if item not in now or now[item] < (ts, id_):
                    now[item] = (ts, id_)
            now = dict(sorted(now.items(), key=lambda x: x[1], reverse=True)[: self.n])
        self.items.put([(item, *at) for item, at in now.items()])
        if self.idle is not None and now:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            newest = pd.Timestamp(next(iter(now.values()))[0]).tz_localize("UTC")
            self.handle.registerTimer(int(newest.timestamp() * 1000) + self.idle)
        yield from self._changes(key, before, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        before = self._held()
        self.items.clear()
        yield from self._changes(key, before, {})

    def close(self) -> None:
        pass


def newest_changes(stream: DataFrame, key: str, item: str, ts: str, tie: str, n: int, idle_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """Changes of the ``n`` newest items of each key: (key, item, ts, id, version, kept), ``kept`` false where an item leaves.

    State is bounded by ``n`` rows a key, whatever arrives; it needs the RocksDB state store (``stateful``)."""
    key_type = dict(stream.dtypes)[key]
    rows = stream.select(F.col(key).alias(key), F.col(item).cast("string").alias("item"), F.col(ts).cast("timestamp").alias("ts"), F.col(tie).cast("long").alias("id"))
    if idle_ms is not None:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(key).transformWithStateInPandas(
        NewestRows(key, n, idle_ms), f"{key} {key_type}, item string, ts timestamp, id long, version long, kept boolean",
        "Append", "None" if idle_ms is None else "EventTime",
    )


def newest_of(changes: DataFrame, key: str) -> DataFrame:
    """The items held at the end of the changes: (key, item, ts, id)."""
    last = F.max_by(F.struct("ts", "id", "kept"), "version")
    return changes.groupBy(key, "item").agg(last.alias("l")).where("l.kept").select(key, "item", "l.ts", "l.id")


@contextmanager
def stateful(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which state of lists and timers needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(df: DataFrame, purpose: str, later: Iterable[Callable[[], None]] = ()) -> DataFrame:
    """Run a stream over everything that has arrived and read its sink back.

    Windows and sessions that the mark has not passed yet are not in the result.
    Each function of ``later`` delivers more input; the stream is taken up again
    from its checkpoint after each.
    """
    spark = df.sparkSession
    out, ck = shared_dir(spark, purpose), shared_dir(spark, f"{purpose}-progress")

    def go() -> None:
        (
            df.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", ck)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )

    go()
    for deliver in later:
        deliver()
        go()
    return spark.read.schema(df.schema).parquet(out)


def arrivals(table: DataFrame, ts: str, key: str, parts: int = 3, close: bool = True) -> tuple[DataFrame, list[Callable[[], None]]]:
    """A table as a stream whose rows arrive in ``parts`` deliveries by time: the stream, and the deliveries after the first.

    Rows with an odd ``key`` of the last half hour of a part come with the next
    one, as rows that are late but within an hour.  ``close`` adds a last
    delivery: one row two days after all others, which lets every window of the
    table end, and copies of the first hour's rows under negative keys, which are
    too late to count.
    """
    spark = table.sparkSession
    folder = shared_dir(spark, "arrivals")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    lo, hi = table.agg(F.min(at), F.max(at)).first()
    span = max(1, ((hi or 0) - (lo or 0)) // parts + 1)
    half_hour = 30 * 60 * 1_000_000
    held = (F.pmod(F.col(key), F.lit(2)) == 1) & (F.pmod(at - F.lit(lo), F.lit(span)) >= span - half_hour)
    part = F.coalesce(F.floor((at - F.lit(lo)) / F.lit(span)), F.lit(0)) + F.when(held, 1).otherwise(0)
    dealt = table.withColumn("_part", F.least(part, F.lit(parts - 1)))

    def part_no(k: int) -> Callable[[], None]:
        return lambda: dealt.filter(F.col("_part") == k).drop("_part").write.mode("append").parquet(folder)

    def closing() -> None:
        again = table.filter(at < F.lit(lo) + 2 * half_hour).withColumn(key, -F.col(key) - 1)
        end = table.filter(at == hi).limit(1).withColumn(ts, F.col(ts) + F.expr("INTERVAL 2 DAYS"))
        again.unionByName(end.withColumn(key, -F.col(key) - 1)).write.mode("append").parquet(folder)

    part_no(0)()
    later = [part_no(k) for k in range(1, parts)] + ([closing] if close and hi is not None else [])
    return spark.readStream.schema(table.schema).parquet(folder), later
