"""The corpus pipeline: toxic documents go, near-duplicates go, repeated passages go, contaminated documents go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquire.llm.chosen_path import one_of_each_group
from sparkquire.llm.common import forget, stored, table
from sparkquire.llm.decontam import without_contaminated
from sparkquire.llm.packing import packed
from sparkquire.llm.suffix_dedup import without_repeats
from sparkquire.llm.toxicity import non_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, all columns kept."""
    return non_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of documents linked by Jaccard similarity, the one with the smallest doc_id; rows without words or doc_id stay."""
    return one_of_each_group(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 50-byte strings that a document with a smaller id holds; n_chars follows the text."""
    out = without_repeats(docs)
    kind = dict(docs.dtypes).get("n_chars")
    return out.withColumn("n_chars", F.length("text").cast(kind)) if kind else out


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [("toxicity", without_toxic), ("jaccard_join", one_of_each), ("suffix_dedup", without_passages), ("decontamination", without_benchmark), ("packing", into_sequences)]

#: SQL cannot express the learned stage; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next, which then deletes it. Packing keeps its own pieces."""
    docs = table(spark, sf_dir, "documents")
    last = None
    for _, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir))
        if last:
            forget(spark, last)
        last = path
    out = STAGES[-1][1](spark, docs, sf_dir)
    forget(spark, last)
    return out
