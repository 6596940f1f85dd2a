"""Run logs, batches, stored projects and recent files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.units import rating


def run_stats(runs: DataFrame, *by: str) -> DataFrame:
    """Totals by status, mean duration of completed runs with a duration, rate.

    The sum is taken over whole milliseconds, so partial sums combine exactly.
    """
    done = F.col("status") == "completed"
    timed = done & (F.coalesce("duration_ms", F.lit(0)) != 0)
    ms = F.sum(F.when(timed, F.col("duration_ms")))
    n = F.count("*")
    return (
        runs.groupBy(*by)
        .agg(
            n.alias("total"),
            F.count_if(done).alias("completed"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            F.count_if(F.col("status") == "cancelled").alias("cancelled"),
            ms.alias("_ms"),
            F.count_if(timed).alias("_timed"),
        )
        .withColumns(
            {
                "avg_duration": F.when(F.col("_timed") > 0, F.col("_ms") / F.col("_timed")).otherwise(0.0),
                "success_rate": F.when(F.col("total") > 0, F.col("completed") / F.col("total") * 100).otherwise(0.0),
            }
        )
        .drop("_ms", "_timed")
    )


def batch_summary(files: DataFrame, *by: str) -> DataFrame:
    """Files by state and the mean progress, half up; failed files keep theirs."""
    return files.groupBy(*by).agg(
        F.count("*").alias("n_files"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.floor(F.sum(F.col("progress").cast("long")) / F.count("*") + 0.5).cast("long").alias("progress"),
    )


def vitals_summary(samples: DataFrame) -> DataFrame:
    """Rating mix per metric, with the largest value of each rating; ``vitals_percentile`` gives percentiles."""
    rated = samples.withColumn("rating", rating(F.col("metric"), F.col("value")))
    return (
        rated.groupBy("metric", "rating")
        .agg(F.count("*").alias("n"), F.max("value").alias("worst"))
    )


def vitals_percentile(samples: DataFrame, p: float = 0.75) -> DataFrame:
    """Approximate percentile per metric; a mergeable sketch, so no sort per metric."""
    return samples.groupBy("metric").agg(F.percentile_approx("value", p, 10000).alias("p"))


def vitals_sketches(samples: DataFrame, width: str = "1 hour", places: int = 4096) -> DataFrame:
    """(metric, window_start, n, sketch): one quantile sketch per metric and time window of samples (metric, ts, value), to be kept as rows."""
    w = F.window("ts", width)
    return samples.groupBy("metric", w.alias("w")).agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", F.lit(places)).alias("sketch")).select(
        "metric", F.col("w.start").alias("window_start"), "n", "sketch"
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, sketch): sketches of windows put together without reading a sample again."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_percentile(sketches: DataFrame, p: float = 0.75) -> DataFrame:
    """Adds ``p``, the percentile of each sketch, within the rank error of its places (exact up to that many samples)."""
    return sketches.withColumn("p", F.kll_sketch_get_quantile_double("sketch", F.lit(p)))


def latest(df: DataFrame, key: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Newest row per key; ``max_by`` combines before the shuffle, so a hot key
    costs one row per task instead of a sort of the whole group."""
    others = [c for c in df.columns if c not in key]
    pick = F.max_by(F.struct(*others), F.struct(ts, tie))
    return df.groupBy(*key).agg(pick.alias("_r")).select(*key, "_r.*")


def top_rows(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """Global first ``n`` rows: a take-ordered plan, not a full sort."""
    return df.orderBy(*order).limit(n)


def recent(df: DataFrame, n: int = 10) -> DataFrame:
    """Newest file per (name, tool), then the ``n`` newest overall."""
    newest = latest(df, ["name", "tool"], "processed_ts", "id")
    return top_rows(newest, n, [F.desc("processed_ts"), F.desc("id")])


def retain(df: DataFrame, n: int, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the ``n`` newest rows per key.

    Two rounds: the best ``n`` of every salt first, then the best ``n`` of the
    survivors, so a hot key is never sorted in one task.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(64))
    best = [F.desc(c) for c in order]
    first = Window.partitionBy(*key, "_salt").orderBy(*best)
    last = Window.partitionBy(*key).orderBy(*best)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(last))
        .filter(F.col("_r") <= n)
        .drop("_salt", "_r")
    )


def search_flows(df: DataFrame, q: str, cols: Sequence[str] = ("name", "description")) -> DataFrame:
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.lower(c).contains(q.lower()), F.lit(False))
    return df.filter(cond)


def apply_updates(rows: DataFrame, updates: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Latest non-null value per id and column; updates of unknown ids are ignored."""
    cols = [c for c in updates.columns if c not in (key, order)]
    folded = updates.groupBy(key).agg(
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_u_{c}")
            for c in cols
        ]
    )
    out = rows.join(folded, key, "left")
    for c in cols:
        old = F.col(c) if c in rows.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(F.col(f"_u_{c}"), old))
    return out.drop(*[f"_u_{c}" for c in cols])


def complete_runs(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """Close runs: updates carry end_ts and status; duration follows from the start."""
    done = apply_updates(rows, updates)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ms = F.floor((micros("end_ts") - micros("start_ts")) / 1000).cast("long")
    return done.withColumn("duration_ms", F.when(F.col("end_ts").isNotNull(), ms).otherwise(F.col("duration_ms")))


def remove(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def projects_by(df: DataFrame, tool: str | None = None, in_progress: bool | None = None) -> DataFrame:
    """Projects of a tool or state, newest first."""
    if tool is not None:
        df = df.filter(F.col("tool") == tool)
    if in_progress is not None:
        df = df.filter(F.col("in_progress") == in_progress)
    return df.orderBy(F.desc("updated_ts"), "id")
