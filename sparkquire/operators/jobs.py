"""Ingestion jobs as an event log: latest state, progress, lists, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query, read

TERMINAL = ("completed", "failed", "cancelled")
#: Event types as job states.
STATES = {"signup": "pending", "view": "processing", "purchase": "completed", "error": "failed", "click": "cancelled"}

LOG_SQL = """log AS (SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'cancelled' END AS status FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS k FROM log),
latest AS (SELECT l.job_id, l.status, l.ts AS updated_at, (SELECT min(ts) FROM log g WHERE g.job_id = l.job_id) AS created_at FROM ranked l WHERE k = 1)"""


def job_log(events: DataFrame) -> DataFrame:
    state = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return events.select(F.col("user_id").alias("job_id"), "event_id", "ts", F.try_element_at(state, F.col("event_type")).alias("status"))


def latest(log: DataFrame) -> DataFrame:
    """job_id, status, updated_at, created_at: one aggregation, partial sums before the shuffle."""
    return log.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("updated_at"), F.min("ts").alias("created_at"))


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(*TERMINAL), F.lit(False))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(job_log(read(spark, sf_dir, "events")))


@query(f"WITH {LOG_SQL} SELECT * FROM latest")
def jobs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir)


@query(f"WITH {LOG_SQL} SELECT job_id, status, created_at FROM latest ORDER BY created_at DESC, job_id LIMIT 20")
def jobs_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).orderBy(F.desc("created_at"), "job_id").limit(20).select("job_id", "status", "created_at")


@query(f"WITH {LOG_SQL} SELECT job_id, status FROM latest WHERE status NOT IN ('completed', 'failed', 'cancelled') OR status IS NULL")
def jobs_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).where(~is_terminal(F.col("status"))).select("job_id", "status")


@query(f"WITH {LOG_SQL} SELECT job_id, status FROM latest WHERE NOT (coalesce(status IN ('completed', 'failed', 'cancelled'), false) AND created_at < (SELECT max(ts) FROM log) - INTERVAL 29 DAY)")
def jobs_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays when terminal jobs created more than 29 days before the clock, the last event's time, go."""
    log = job_log(read(spark, sf_dir, "events"))
    old = is_terminal(F.col("status")) & (F.col("created_at") < F.col("now") - F.expr("interval 29 days"))
    return latest(log).crossJoin(F.broadcast(log.agg(F.max("ts").alias("now")))).where(~old).select("job_id", "status")


@query(f"WITH {LOG_SQL}, steps AS (SELECT job_id, count(*) AS n, count(*) FILTER (status = 'processing') AS done FROM log GROUP BY job_id) SELECT job_id, CASE WHEN status = 'completed' THEN 100.0 ELSE CAST(done AS DOUBLE) / n * 100 END AS percent FROM steps JOIN latest USING (job_id)")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps done of all, in percent; a completed job has 100."""
    log = job_log(read(spark, sf_dir, "events"))
    s = log.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n"), F.count_if(F.col("status") == "processing").alias("done"))
    return s.select("job_id", F.when(F.col("status") == "completed", 100.0).otherwise(F.col("done") / F.col("n") * 100).alias("percent"))


@query(f"WITH {LOG_SQL}, spans AS (SELECT job_id, min(ts) FILTER (status = 'processing') AS began, max(ts) FILTER (status IN ('completed', 'failed', 'cancelled')) AS ended FROM log GROUP BY job_id) SELECT job_id, CASE WHEN began IS NULL THEN NULL ELSE CAST(date_diff('microsecond', began, coalesce(ended, (SELECT max(ts) FROM log))) AS DOUBLE) / 1000000 END AS seconds FROM spans")
def job_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first start to the last end, or to the clock; null for a job that never started."""
    log = job_log(read(spark, sf_dir, "events"))
    s = log.groupBy("job_id").agg(F.min(F.when(F.col("status") == "processing", F.col("ts"))).alias("began"), F.max(F.when(is_terminal(F.col("status")), F.col("ts"))).alias("ended"))
    now = F.broadcast(log.agg(F.max("ts").alias("now")))
    return s.crossJoin(now).select("job_id", (F.expr("timestampdiff(MICROSECOND, began, coalesce(ended, now))") / 1000000.0).alias("seconds"))


@query("SELECT user_id AS job_id, count(*) AS files, count(*) * 5 AS total_steps, count(*) * 10 AS estimated_seconds, CASE WHEN count(*) = 1 THEN 'ingest_single' ELSE 'ingest_batch' END AS kind FROM events WHERE event_type = 'view' GROUP BY user_id")
def job_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five steps and ten seconds a file; single or batch by their number."""
    n = read(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("job_id")).agg(F.count("*").alias("files"))
    return n.select("job_id", "files", (F.col("files") * 5).alias("total_steps"), (F.col("files") * 10).alias("estimated_seconds"), F.when(F.col("files") == 1, "ingest_single").otherwise("ingest_batch").alias("kind"))
