"""Streams: job events to latest state, rows appended batch by batch, new files as they come."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jobs import job_log, latest
from ..plans.registry import query, read


def shared(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared checkpoint folder, or a local one where none is set."""
    import tempfile

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quire-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def appended_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream's rows to ``path`` in batches; the batch id makes a repeated batch replace itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(events: DataFrame) -> DataFrame:
    """The latest state of each job, for update or complete mode; late events are counted up to a day."""
    return latest(job_log(events.withWatermark("ts", "1 day")))


def new_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of files (path, modificationTime, length, content) as they come."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)


@query("SELECT event_id, user_id, event_type FROM events")
def a2t_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, streamed from their file and appended in batches."""
    schema = read(spark, sf_dir, "events").schema
    out = shared(spark, "append")
    appended_stream(spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet"), out, shared(spark, "mark")).awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/*").select("event_id", "user_id", "event_type")
