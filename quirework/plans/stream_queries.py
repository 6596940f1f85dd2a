"""Streams over the given tables, drained into a table folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.plans.registry import query
from quirework.plans.views import table
from quirework.session import shared_dir
from quirework.sources.readers import read_files
from quirework.streaming import jobs

# Fixed value: rows up to one hour late are still counted.
LATE = "1 hour"


def _events(spark, sf, close=True):
    """Events in three deliveries and a closing one, with late rows in each."""
    stream, later = jobs.arrivals(table(spark, sf, "events"), "ts", "event_id", close=close)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")), later


def _run_stream(events):
    t = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("start_ts"),
        F.floor("value").cast("long").alias("duration_ms"),
        F.when(t == "error", "failed").when(t == "purchase", "completed").when(t == "view", "cancelled").otherwise("running").alias("status"),
    )


@query("""
WITH r AS (SELECT date_trunc('day', ts) AS window_start, CAST(floor(value) AS BIGINT) AS ms,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'cancelled' ELSE 'running' END AS status FROM events)
SELECT strftime(window_start, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'cancelled') AS cancelled, round(coalesce(avg(ms) FILTER (status = 'completed' AND ms <> 0), 0), 6) AS avg_duration,
  round(count(*) FILTER (status = 'completed') * 100.0::DOUBLE / count(*), 6) AS success_rate
FROM r GROUP BY window_start
""")
def stream_run_stats(spark, sf):
    """Daily statistics; a day is emitted once the mark has passed its end."""
    events, later = _events(spark, sf)
    out = jobs.drain(jobs.run_stats_windows(_run_stream(events), "1 day", late=LATE), "run-stats", later)
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "total", "completed", "failed", "cancelled",
        F.round("avg_duration", 6).alias("avg_duration"), F.round("success_rate", 6).alias("success_rate"),
    )


@query("""
WITH d AS (SELECT date_trunc('day', ts) AS d, event_type AS status, CAST(floor(value) AS BIGINT) AS p FROM events)
SELECT strftime(d, '%Y-%m-%d') AS day, status, count(*) AS n, CAST(sum(p) AS BIGINT) AS progress_sum FROM d GROUP BY ALL
""")
def stream_batch_progress(spark, sf):
    events, later = _events(spark, sf)
    e = events.select(
        F.col("event_id").alias("update_id"), "ts", F.col("event_type").alias("status"), F.floor("value").cast("long").alias("progress")
    )
    # every update arrives twice; the repeat must not count
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = jobs.drain(jobs.batch_progress(twice, LATE), "batch-progress", later)
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "status", "n", "progress_sum")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
x AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS b, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, epoch_us(a) AS start_us, epoch_us(b) AS end_us, n AS n_runs FROM x
""")
def stream_user_sessions(spark, sf):
    events, later = _events(spark, sf)
    out = jobs.drain(jobs.user_sessions(events, "6 hours", LATE), "sessions", later)
    return out.select(
        "user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n_runs"
    )


_RECENT = ["name", "tool"], "processed_ts", "id"


def _recent(spark, sf):
    """Newest event per user and type, kept over three deliveries with every second one folding."""
    events, later = _events(spark, sf, close=False)
    e = events.select(
        F.col("user_id").alias("name"), F.col("event_type").alias("tool"), F.col("event_id").alias("id"), F.col("ts").alias("processed_ts")
    )
    path, ck = shared_dir(spark, "recent"), shared_dir(spark, "recent-progress")
    for deliver in (lambda: None, *later):
        deliver()
        jobs.keep_latest(e, path, *_RECENT, ck, fold_every=2).awaitTermination()
    return jobs.read_latest(spark, path, *_RECENT)


@query("""
SELECT user_id AS name, event_type AS tool, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY ALL
""")
def stream_recent_files(spark, sf):
    return _recent(spark, sf).select("name", "tool", "id")


@query("""
WITH l AS (SELECT user_id AS name, event_type AS tool, arg_max(event_id, (ts, event_id)) AS id, max(ts) AS t FROM events GROUP BY ALL)
SELECT name, tool, id FROM l QUALIFY row_number() OVER (PARTITION BY name ORDER BY t DESC, id DESC) <= 3
""")
def stream_recent_per_user(spark, sf):
    """The three newest types of each user, held as state over three deliveries and restarts."""
    events, later = _events(spark, sf, close=False)
    with jobs.stateful(spark):
        changes = jobs.drain(jobs.newest_changes(events, "user_id", "event_type", "ts", "event_id", 3), "newest", later)
    return jobs.newest_of(changes, "user_id").select(F.col("user_id").alias("name"), F.col("item").alias("tool"), "id")


def _document_files(spark, sf):
    """The documents of each source as one text file in a folder of that name."""
    path = shared_dir(spark, "document-files")
    docs = table(spark, sf, "documents").select("source", "text")
    docs.repartition("source").write.partitionBy("source").text(path)
    return path


def _source():
    return F.url_decode(F.regexp_extract("path", "source=([^/]*)/", 1))


_FILES = "SELECT source, 'text/plain' AS mime, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size_bytes FROM documents GROUP BY source"


@query(_FILES)
def stream_file_intake(spark, sf):
    """Files written from the documents, as they arrive."""
    files = jobs.intake(spark, f"{_document_files(spark, sf)}/*", "*.txt", content=False)
    return jobs.drain(files.select(_source().alias("source"), "mime", "size_bytes"), "intake")


@query("""
SELECT source, code, message FROM (SELECT DISTINCT source FROM documents), (VALUES
  ('FILE_TYPE_INVALID', 'Invalid file type. Expected: application/pdf'), ('FILE_NOT_PDF', 'The file does not appear to be a valid PDF.')) e(code, message)
""")
def stream_intake_errors(spark, sf):
    """Error rows of the arriving files: none of them is a PDF file."""
    files = jobs.intake(spark, f"{_document_files(spark, sf)}/*", "*.txt")
    errors = jobs.intake_errors(files.withColumn("doc_id", _source()))
    return jobs.drain(errors.select(F.col("doc_id").alias("source"), "code", "message"), "intake-errors")


@query(_FILES)
def file_manifest(spark, sf):
    return read_files(spark, _document_files(spark, sf), "*.txt").select(_source().alias("source"), "mime", "size_bytes")
