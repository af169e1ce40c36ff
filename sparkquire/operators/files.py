"""Stored documents, images, jobs and graphs: what is written where, what is read back, and figures asked for by id."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query, read
from ..sources.corpus import FORMATS, assembled
from .graph import NODES_SQL, edges, nodes
from .jobs import TERMINAL, is_terminal
from .scalars import media_type

#: The largest image that is taken, in MB, and the places of a graph's attributes in its file.
LARGEST, TYPE, DESCRIPTION, WEIGHT, KEYWORDS = 10.0, "d1", "d2", "d7", "d9"


# Documents and images


def save_markdown(pages: DataFrame, path: str) -> None:
    """Each document's text, in its own partition; documents saved again replace themselves, others stay."""
    assembled(pages).select("doc_id", "md").write.partitionBy("doc_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def load_markdown(spark: SparkSession, path: str, doc_id: str) -> DataFrame:
    """doc_id, md: no row where there is none. Reads that document's partition alone."""
    return spark.read.schema("md string, doc_id string").parquet(path).where(F.col("doc_id") == doc_id).select("doc_id", "md")


def save_manifests(manifests: DataFrame, path: str) -> None:
    """doc_id, manifest: one line of JSON a document, with the place where it is kept among its fields."""
    placed = manifests.select(F.regexp_replace("manifest", r"\}$", f', "manifest_path": "{path}"}}').alias("value"))
    placed.write.mode("overwrite").text(path)


def save_images(images: DataFrame, path: str) -> None:
    """doc_id, image_id, ext, content: one partition a document, replaced when saved again."""
    images.select("image_id", "ext", "content", "doc_id").write.partitionBy("doc_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def load_image(spark: SparkSession, path: str, doc_id: str, image_id: str) -> DataFrame:
    """ext, content of the image under the first ending of FORMATS that it has."""
    own = spark.read.schema("image_id string, ext string, content binary, doc_id string").parquet(path).where((F.col("doc_id") == doc_id) & (F.col("image_id") == image_id))
    order = F.array_position(F.array(*map(F.lit, FORMATS)), F.lower("ext"))
    return own.where(order > 0).orderBy(order).limit(1).select("ext", "content")


def size_kb(files: DataFrame) -> DataFrame:
    """path, kb of binary files (path, length); a file that is not there has 0."""
    return files.select("path", (F.coalesce("length", F.lit(0)) / 1024).alias("kb"))


def fetched_figures(asked: DataFrame, manifests: DataFrame, figures: DataFrame, images: DataFrame, largest: float = LARGEST) -> DataFrame:
    """A row for each of ``asked`` (doc_id, asset_id): success, error, image_base64, media_type, page, width, height, text.

    ``figures``: doc_id, id, page, caption, path, ext, width, height; ``images``: path, content. Without an imaging library bytes are handed
    out as they are. An image over ``largest`` MB was never taken, so it is missing. Only wanted figures' images are read.
    """
    own = figures.select("doc_id", F.col("id").alias("asset_id"), "page", "path", "ext", "width", "height")
    known = asked.join(manifests.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left").join(own, ["doc_id", "asset_id"], "left")
    got = known.join(images.where(F.length("content") <= int(largest * (1 << 20))), "path", "left")
    error = (
        F.when(F.col("known").isNull(), "Manifest not found").when(F.col("path").isNull(), F.concat(F.lit("Figure not found: "), "asset_id"))
        .when(F.col("content").isNull(), F.concat(F.lit("Image not found: "), "path"))
    )
    fine = lambda c: F.when(error.isNull(), c)
    return got.select(
        "doc_id", "asset_id", error.isNull().alias("success"), error.alias("error"), fine(F.regexp_replace(F.base64("content"), "[\r\n]", "")).alias("image_base64"), fine(media_type(F.col("ext"))).alias("media_type"),
        fine(F.col("page")).alias("page"), fine(F.col("width")).alias("width"), fine(F.col("height")).alias("height"), fine(F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" (unprocessed)"))).alias("text"),
    )


FIGURES_SQL = """figures AS (SELECT 'doc_src' || (item_id % 20) AS doc_id, 'fig_' || (item_id // 20 + 1) || '_1' AS id, item_id // 20 + 1 AS page, CASE WHEN item_id % 3 = 0 THEN '' ELSE substring(text, 1, 60) END AS caption, 'images/' || item_id AS path, CASE WHEN item_id % 2 = 0 THEN 'png' ELSE 'JPG' END AS ext, CASE WHEN item_id % 7 <> 0 THEN encode(text) END AS content FROM benchmark)"""


def figures_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invented figures, one for each item of ``benchmark``; some have lost their image."""
    k = F.col("item_id")
    page = F.floor(k / 20) + 1
    return read(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("doc_src"), (k % 20).cast("string")).alias("doc_id"), F.concat(F.lit("fig_"), page.cast("string"), F.lit("_1")).alias("id"), page.alias("page"), F.when(k % 3 == 0, "").otherwise(F.substring("text", 1, 60)).alias("caption"),
        F.concat(F.lit("images/"), k.cast("string")).alias("path"), F.when(k % 2 == 0, "png").otherwise("JPG").alias("ext"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.when(k % 7 != 0, F.col("text").cast("binary")).alias("content"),
    )


@query(
    f"WITH {FIGURES_SQL}, asked AS (SELECT DISTINCT 'doc_src' || (item_id % 23) AS doc_id, 'fig_' || (item_id % 4 + 1) || '_1' AS asset_id FROM benchmark) SELECT a.doc_id, a.asset_id, content IS NOT NULL AS success, "
    "CASE WHEN NOT EXISTS (SELECT 1 FROM figures m WHERE m.doc_id = a.doc_id) THEN 'Manifest not found' WHEN f.id IS NULL THEN 'Figure not found: ' || a.asset_id WHEN content IS NULL THEN 'Image not found: ' || path END AS error, md5(to_base64(content)) AS digest, "
    "CASE WHEN content IS NULL THEN NULL WHEN ext = 'png' THEN 'image/png' ELSE 'image/jpeg' END AS media_type, CASE WHEN content IS NOT NULL THEN page END AS page FROM asked a LEFT JOIN figures f ON a.doc_id = f.doc_id AND a.asset_id = f.id"
)
def fetch_figure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures by exact id, of unknown documents, unknown figures and lost images too."""
    figures, k = figures_of(spark, sf_dir), F.col("item_id")
    asked = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("doc_src"), (k % 23).cast("string")).alias("doc_id"), F.concat(F.lit("fig_"), (k % 4 + 1).cast("string"), F.lit("_1")).alias("asset_id")).distinct()
    out = fetched_figures(asked, figures, figures.drop("content"), figures.where("content is not null").select("path", "content"))
    return out.select("doc_id", "asset_id", "success", "error", F.md5("image_base64").alias("digest"), "media_type", "page")


# Jobs


JOB = "job_id string, status string, job_type string, input_files array<string>, percentage double, message string, output_doc_ids array<string>, error string, created_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz"


@dataclass(frozen=True)
class Jobs:
    """A store of jobs, a row each; every change gives a new store."""

    spark: SparkSession
    jobs: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Jobs:
        return Jobs(spark, spark.createDataFrame([], JOB))

    def get(self, job_id: str):
        found = self.jobs.where(F.col("job_id") == job_id).take(1)
        return found[0] if found else None

    def create(self, job_id: str, files: list[str], now: datetime | None = None) -> Jobs:
        """Refused where the id is taken. One file is a single job, several are a batch."""
        if self.get(job_id):
            raise ValueError(f"Job {job_id} already exists")
        one = (job_id, "pending", "ingest_single" if len(files) == 1 else "ingest_batch", list(files), 0.0, "", [], None, now or datetime.now(), None, None)
        return replace(self, jobs=self.jobs.unionByName(self.spark.createDataFrame([one], JOB)))

    def update(self, job_id: str, **fields) -> Jobs:
        """Blindly overwrites fields of a job."""
        here = F.col("job_id") == job_id
        kinds = {f.name: f.dataType for f in self.jobs.schema.fields}
        return replace(self, jobs=self.jobs.withColumns({k: F.when(here, F.lit(v).cast(kinds[k])).otherwise(F.col(k)) for k, v in fields.items()}))

    def start(self, job_id: str, now: datetime | None = None) -> Jobs:
        return self.update(job_id, status="processing", started_at=now or datetime.now())

    def progress(self, job_id: str, step: int, total: int, message: str = "") -> Jobs:
        """The share of steps done, unchanged where there are none."""
        return self.update(job_id, message=message, **({"percentage": step / total * 100} if total > 0 else {}))

    def complete(self, job_id: str, docs: list[str], now: datetime | None = None) -> Jobs:
        return self.update(job_id, status="completed", percentage=100.0, output_doc_ids=docs, completed_at=now or datetime.now())

    def fail(self, job_id: str, error: str, now: datetime | None = None) -> Jobs:
        return self.update(job_id, status="failed", error=error, completed_at=now or datetime.now())

    def cancel(self, job_id: str, now: datetime | None = None) -> tuple[Jobs, bool]:
        """False where there is no such job or it has ended. Its running Spark work is tagged with its id and cancelled too."""
        job = self.get(job_id)
        if job is None or job.status in TERMINAL:
            return self, False
        self.spark.sparkContext.cancelJobsWithTag(job_id)
        return self.update(job_id, status="cancelled", completed_at=now or datetime.now()), True

    def delete(self, job_id: str) -> tuple[Jobs, bool]:
        return replace(self, jobs=self.jobs.where(F.col("job_id") != job_id)), self.get(job_id) is not None

    def recent(self, limit: int = 50) -> DataFrame:
        return self.jobs.orderBy(F.desc("created_at"), "job_id").limit(limit)

    def active(self) -> DataFrame:
        return self.jobs.where(~is_terminal(F.col("status")))

    def cleanup(self, hours: float, now: datetime | None = None) -> tuple[Jobs, int]:
        """Without the ended jobs made more than ``hours`` ago, and how many these were."""
        old = is_terminal(F.col("status")) & (F.col("created_at") < F.lit((now or datetime.now()) - timedelta(hours=hours)))
        return replace(self, jobs=self.jobs.where(~old)), self.jobs.where(old).count()

    def save(self, path: str) -> None:
        self.jobs.write.mode("overwrite").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Jobs:
        """Files that cannot be read are passed over."""
        return Jobs(spark, spark.read.schema(JOB).option("mode", "DROPMALFORMED").json(path).where("job_id is not null"))


# Graphs

DATA = "data array<struct<_VALUE string, _key string>>"


def _data(key: str):
    return F.element_at(F.filter("data", lambda d: d["_key"] == key), 1)["_VALUE"]


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, description, ordinal) and edges (source, target, keywords, weight) of GraphML files, nodes in file order; a weight not given is 1.0."""
    got = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", "false").schema(f"{schema}, {DATA}").load(path)
    text = lambda key: F.coalesce(_data(key), F.lit(""))
    found = got("node", "_id string").select(F.col("_id").alias("id"), text(TYPE).alias("type"), text(DESCRIPTION).alias("description"), F.monotonically_increasing_id().alias("ordinal"))
    return found, got("edge", "_source string, _target string").select(F.col("_source").alias("source"), F.col("_target").alias("target"), text(KEYWORDS).alias("keywords"), F.coalesce(_data(WEIGHT), F.lit("1.0")).alias("weight"))


def as_graphml(found: DataFrame, links: DataFrame) -> DataFrame:
    """value: a GraphML element for each node and edge."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), safe(c), F.lit("</data>"))
    return found.select(F.concat(F.lit('<node id="'), safe("id"), F.lit('">'), data(TYPE, "type"), data(DESCRIPTION, "description"), F.lit("</node>")).alias("value")).unionByName(
        links.select(F.concat(F.lit('<edge source="'), safe("source"), F.lit('" target="'), safe("target"), F.lit('">'), data(WEIGHT, "weight"), data(KEYWORDS, "keywords"), F.lit("</edge>")).alias("value"))
    )


@query(f"WITH {NODES_SQL} SELECT id AS a, type AS b, description AS c FROM nodes UNION ALL SELECT source, target, keywords || '/' || weight FROM edges")
def kg_graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as GraphML elements and parsed again."""
    xml = as_graphml(nodes(spark, sf_dir), edges(spark, sf_dir))
    text = lambda key: F.coalesce(F.element_at(F.filter("x.data", lambda d: d["_key"] == key), 1)["_VALUE"], F.lit(""))
    got = xml.withColumn("x", F.from_xml("value", f"_id string, _source string, _target string, {DATA}", {"ignoreSurroundingSpaces": "false"}))
    node = F.col("x._id").isNotNull()
    return got.select(F.coalesce("x._id", "x._source").alias("a"), F.when(node, text(TYPE)).otherwise(F.col("x._target")).alias("b"), F.when(node, text(DESCRIPTION)).otherwise(F.concat(text(KEYWORDS), F.lit("/"), text(WEIGHT))).alias("c"))


def exported(spark: SparkSession, path: str, form: str = "summary", types: list[str] | None = None, limit: int = 50) -> dict[str, DataFrame]:
    """The parts of a graph file's export: nodes kept by type and place, and the edges between them; for a summary their counts by type. Unknown forms and missing files are refused."""
    from .graph import inner_edges, kept_nodes

    if form not in ("summary", "json", "mermaid"):
        raise ValueError(f"Unknown format: {form}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError("Knowledge graph not found. Please ingest documents first.")
    found, links = graphml(spark, path)
    kept = kept_nodes(found, types, 30 if form == "mermaid" else limit)
    out = {"nodes": kept, "edges": inner_edges(links, kept)}
    return out | ({"types": kept.groupBy("type").agg(F.count("*").alias("n"))} if form == "summary" else {})
