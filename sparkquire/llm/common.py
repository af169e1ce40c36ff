"""Helpers shared by the training-data operators: shared storage, folds, column checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which an execution's shuffle files go as soon as it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Hadoop's settings by which files in a local folder get no checksum file beside them. Without its native library Hadoop starts a ``chmod``
#: for each of the two, and until that process has begun, the executor's memory counts twice.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only a local master may leave it unset, and gets a folder of this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = getattr(spark, "_quire_scratch", None) or tempfile.mkdtemp(prefix="quire-")
        spark._quire_scratch = named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Executions made within delete their shuffle files when they end, and write local files plainly (`PLAIN`)."""
    was, hadoop = spark.conf.get(TIDY, "false"), spark.sparkContext._jsc.hadoopConfiguration()
    kept = {key: hadoop.get(key) for key in PLAIN}
    spark.conf.set(TIDY, "true")
    for key, value in PLAIN.items():
        hadoop.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(TIDY, was)
        for key, value in kept.items():
            hadoop.unset(key) if value is None else hadoop.set(key, value)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so no later stage recomputes it; its shuffle files go at once."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def free(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read again; its path is for `forget`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quire-{uuid.uuid4().hex}"
    with tidy(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that `stored` wrote."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def bounded_labels(labels: DataFrame, column: str, rows: int, folds: int = 5, out: int = 0) -> list[tuple[int, int]]:
    """At most ``rows`` labelled keys outside fold ``out``, the first by a hash of doc_id.

    Null keys and null labels are left out; a doc_id labelled more than once takes its largest label.
    """
    picked = (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("doc_id"), folds) != out))
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.desc("label"))
        .limit(rows)
        .collect()
    )
    seen: dict[int, int] = {}
    for row in picked:
        seen.setdefault(row.doc_id, row.label)
    return list(seen.items())


def labelled_docs(docs: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """doc_id, text, label of the documents named by ``pairs``, whose length its caller bounds."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = spark.createDataFrame(pairs, f"doc_id {kind}, label int")
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(keys), "doc_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
