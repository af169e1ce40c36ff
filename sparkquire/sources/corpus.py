"""Page-marked markdown from page rows: pages as rows, whole documents as strings, and other sources of pages.

Real decoders plug in as any DataFrame of (source, pg, t); the given tables make one from ``documents`` and ``labels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query, read

PAGES_SQL = """
numbered AS (
  SELECT d.source, d.doc_id AS n, d.text, l.quality, l.toxic, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS pg
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
page_rows AS (
  SELECT 'doc_' || source AS doc_id, pg, chr(10) || '<!-- Page ' || CAST(pg AS VARCHAR) || ' -->' || chr(10) || chr(10)
    || CASE WHEN pg = 1 THEN '# Source ' || source || chr(10) ELSE '' END
    || CASE WHEN pg % 5 = 1 THEN chr(10) || '## **Part** ' || CAST((pg + 4) // 5 AS VARCHAR) || chr(10) ELSE '' END
    || chr(10) || '### Document ' || CAST(n AS VARCHAR) || chr(10) || chr(10) || text
    || CASE WHEN quality IS NULL THEN '' ELSE chr(10) || chr(10) || '| quality | toxic |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || CAST(quality AS VARCHAR) || ' | ' || CAST(toxic AS VARCHAR) || ' |' || chr(10) END AS t
  FROM numbered),
corpus AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY pg) AS md, count(*) AS pages FROM page_rows GROUP BY doc_id)
"""


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pg, t: one row for each page, its marker and text."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    d = docs.join(labels, "doc_id", "left").withColumn("pg", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    table = F.when(F.col("quality").isNull(), "").otherwise(F.concat(F.lit("\n\n| quality | toxic |\n| --- | --- |\n| "), F.col("quality").cast("string"), F.lit(" | "), F.col("toxic").cast("string"), F.lit(" |\n")))
    t = F.concat(
        F.lit("\n<!-- Page "), F.col("pg").cast("string"), F.lit(" -->\n\n"), F.when(F.col("pg") == 1, F.concat(F.lit("# Source "), "source", F.lit("\n"))).otherwise(""),
        F.when(F.col("pg") % 5 == 1, F.concat(F.lit("\n## **Part** "), F.floor((F.col("pg") + 4) / 5).cast("string"), F.lit("\n"))).otherwise(""), F.lit("\n### Document "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.col("text"), table,
    )
    return d.select(F.concat(F.lit("doc_"), "source").alias("doc_id"), "pg", t.alias("t"))


def assembled(pages: DataFrame) -> DataFrame:
    """doc_id, md, pages: a document's pages in order, joined by line feeds."""
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pg", "t"))), lambda x: x.t), "\n").alias("md"), F.count("*").alias("pages"))


def lines(pages: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0 over the document), line, pg: without putting the document together, so that a long one is never one row."""
    own = Window.partitionBy("doc_id").orderBy("pg").rowsBetween(Window.unboundedPreceding, -1)
    parts = pages.withColumn("parts", F.split("t", "\n", -1))
    base = parts.withColumn("base", F.coalesce(F.sum(F.size("parts")).over(own), F.lit(0)))
    return base.select("doc_id", "pg", "base", F.posexplode("parts").alias("at", "line")).select("doc_id", (F.col("base") + F.col("at")).alias("line_no"), "line", "pg")


@query(f"WITH {PAGES_SQL} SELECT doc_id, md5(md) AS digest, length(md) AS n_chars, pages FROM corpus")
def corpus_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembled(page_rows(spark, sf_dir)).select("doc_id", F.md5("md").alias("digest"), F.length("md").cast("long").alias("n_chars"), "pages")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, md of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("md"))


def manifests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored manifest files; one that cannot be read gives no row."""
    return spark.read.schema(schema + ", _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").json(path).where("doc_id is not null").drop("_corrupt_record")


def images(spark: SparkSession, path: str) -> DataFrame:
    """image id, content: of files that differ in their ending only, the first by ``FORMATS``."""
    files = spark.read.format("binaryFile").load(path)
    name, ending = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    order = F.array_position(F.array(*map(F.lit, FORMATS)), ending)
    return files.select(name.alias("image_id"), "content", order.alias("o")).where("o > 0").groupBy("image_id").agg(F.min_by("content", "o").alias("content"))


#: Image endings in the order in which they are looked for.
FORMATS = ("png", "jpg", "jpeg", "gif", "webp")
