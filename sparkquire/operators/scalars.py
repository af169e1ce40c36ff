"""Identifiers, media types, type detection, estimates and image geometry as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pytext import slug, strip, token_estimate
from ..plans.registry import query, read

#: Media types by ending.
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}
#: Document types by terms of which three must occur, in this order.
TERMS = {
    "medical": ("patient", "diagnosis", "treatment", "clinical", "drug", "dose", "mg", "ml", "syndrome", "disease"),
    "technical": ("algorithm", "implementation", "function", "class", "method", "api", "code", "parameter", "import", "def "),
    "legal": ("hereby", "whereas", "agreement", "party", "clause", "section", "liability", "indemnify"),
}
#: File name parts of simple documents, and words of question intents, in this order.
SIMPLE = (".md", ".txt", ".rst")
INTENTS = (("comparison", ("比較", "compare", "vs", "差異", "different")), ("citation", ("引用", "cite", "reference", "來源", "source")))
#: Chunk size and overlap by document type; the least chunk is always 100.
PRESETS = {"general": (1000, 200), "technical": (1500, 300), "simple": (800, 160), "legal": (1200, 400), "medical": (1000, 250)}


def doc_id(filename: Column, unique: Column) -> Column:
    return F.concat(F.lit("doc_"), slug(filename), F.lit("_"), F.substring(F.md5(unique), 1, 6))


def media_type(ending: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.ltrim(ending, F.lit(".")))), F.lit("image/png"))


def doc_type(text: Column, filename: Column) -> Column:
    sample = F.lower(F.substring(text, 1, 5000))
    out = F.when(F.lower(filename).rlike(r"\.md|\.txt|\.rst"), "simple")
    for kind, terms in TERMS.items():
        hits = sum((sample.contains(t).cast("int") for t in terms[1:]), sample.contains(terms[0]).cast("int"))
        out = out.when(hits >= 3, kind)
    return out.otherwise("general")


def intent(question: Column) -> Column:
    out = None
    for kind, words in INTENTS:
        hit = F.lower(question).rlike("|".join(words))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("summary")


FILES_SQL = "files AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) || '.' || CASE WHEN page_id % 7 = 0 THEN 'PDF' WHEN page_id % 7 = 1 THEN 'txt' ELSE 'pdf' END AS filename FROM pages)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invented file names for the rows of ``pages``, some not PDF."""
    ending = F.when(F.col("page_id") % 7 == 0, "PDF").when(F.col("page_id") % 7 == 1, "txt").otherwise("pdf")
    return read(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("."), ending).alias("filename"))


@query(f"WITH {FILES_SQL} SELECT page_id, 'doc_' || substring(regexp_replace(lower(filename), '[^a-z0-9]', '_', 'g'), 1, 30) || '_' || substring(md5(url), 1, 6) AS doc_id FROM files")
def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("page_id", doc_id(F.col("filename"), F.col("url")).alias("doc_id"))


@query("SELECT page_id, regexp_matches(url, '^doc_[a-z0-9_]+$') AS plain, regexp_matches('doc_' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 3 = 0 THEN 'X' ELSE '' END, '^doc_[a-z0-9_]+$') AS made FROM pages")
def doc_id_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("doc_"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, "X").otherwise(""))
    valid = lambda c: c.rlike(r"(?d)^doc_[a-z0-9_]+\z")
    return read(spark, sf_dir, "pages").select("page_id", valid(F.col("url")).alias("plain"), valid(made).alias("made"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'image/png' WHEN doc_id % 6 IN (1, 2) THEN 'image/jpeg' WHEN doc_id % 6 = 3 THEN 'image/gif' WHEN doc_id % 6 = 4 THEN 'image/webp' WHEN doc_id % 60 = 5 THEN 'image/png' ELSE 'image/bmp' END AS media FROM documents")
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ("PNG", "jpg", "JPEG", "gif", "webp", "bmp"))), (F.col("doc_id") % 6 + 1).cast("int"))
    ending = F.when(F.col("doc_id") % 60 == 5, "tiff").otherwise(ending)
    return read(spark, sf_dir, "documents").select("doc_id", media_type(ending).alias("media"))


def _terms_sql(kind: str, sample: str = "sample") -> str:
    return " + ".join(f"CAST(contains({sample}, '{t}') AS INTEGER)" for t in TERMS[kind])


def kind_sql(text: str) -> str:
    """`doc_type` of a text whose file name says nothing, in DuckDB."""
    return "CASE " + " ".join(f"WHEN {_terms_sql(kind, f'lower(substring({text}, 1, 5000))')} >= 3 THEN '{kind}'" for kind in TERMS) + " ELSE 'general' END"


@query(
    f"SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'simple' WHEN {_terms_sql('medical')} >= 3 THEN 'medical' WHEN {_terms_sql('technical')} >= 3 THEN 'technical' WHEN {_terms_sql('legal')} >= 3 THEN 'legal' ELSE 'general' END AS kind "
    "FROM (SELECT doc_id, lower(substring(CASE WHEN doc_id % 5 = 0 THEN 'Patient dose 5 mg ' WHEN doc_id % 5 = 1 THEN 'import class method ' WHEN doc_id % 5 = 2 THEN 'Whereas the party, hereby ' ELSE '' END || text, 1, 5000)) AS sample FROM documents) s",
    name="doc_type",
)
def doc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.when(F.col("doc_id") % 5 == 0, "Patient dose 5 mg ").when(F.col("doc_id") % 5 == 1, "import class method ").when(F.col("doc_id") % 5 == 2, "Whereas the party, hereby ").otherwise("")
    name = F.when(F.col("doc_id") % 11 == 0, "Notes.TXT").otherwise("paper.pdf")
    return read(spark, sf_dir, "documents").select("doc_id", doc_type(F.concat(lead, "text"), name).alias("kind"))


@query("SELECT * FROM (VALUES ('general', 1000, 200, 100), ('technical', 1500, 300, 100), ('simple', 800, 160, 100), ('legal', 1200, 400, 100), ('medical', 1000, 250, 100)) AS p(kind, size, overlap, least)")
def chunk_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, s, o, 100) for k, (s, o) in PRESETS.items()], "kind string, size int, overlap int, least int")


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents", name="token_estimate")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '比較|compare|vs|差異|different') THEN 'comparison' WHEN regexp_matches(lower(text), '引用|cite|reference|來源|source') THEN 'citation' ELSE 'summary' END AS intent FROM conversations")
def plan_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", intent(F.col("text")).alias("intent"))


@query(
    "SELECT p_partkey, w, h, CASE WHEN m <= 0 OR greatest(w, h) <= m THEN w WHEN w > h THEN m ELSE CAST(floor(w * (CAST(m AS DOUBLE) / h)) AS BIGINT) END AS new_w, CASE WHEN m <= 0 OR greatest(w, h) <= m THEN h WHEN w > h THEN CAST(floor(h * (CAST(m AS DOUBLE) / w)) AS BIGINT) ELSE m END AS new_h "
    "FROM (SELECT p_partkey, p_partkey % 3001 + 1 AS w, p_partkey * 7 % 2003 + 1 AS h, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1024 END AS m FROM part) s"
)
def resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes after the longer side is brought down to the limit; no limit: unchanged."""
    k = F.col("p_partkey")
    s = read(spark, sf_dir, "part").select("p_partkey", (k % 3001 + 1).alias("w"), (k * 7 % 2003 + 1).alias("h"), F.when(k % 10 == 0, 0).otherwise(1024).cast("long").alias("m"))
    w, h, m = F.col("w"), F.col("h"), F.col("m")
    same = (m <= 0) | (F.greatest(w, h) <= m)
    return s.select("p_partkey", "w", "h", F.when(same, w).when(w > h, m).otherwise(F.floor(w * (m / h))).alias("new_w"), F.when(same, h).when(w > h, F.floor(h * (m / w))).otherwise(m).alias("new_h"))


@query("SELECT doc_id, CASE WHEN a = 0 THEN 1.0 ELSE CAST(b AS DOUBLE) / a END AS ratio, CASE WHEN a = 0 THEN 0.0 ELSE (1 - CAST(b AS DOUBLE) / a) * 100 END AS saved FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE n_chars END AS a, n_chars // 3 AS b FROM documents) s")
def image_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.when(F.col("doc_id") % 9 == 0, 0).otherwise(F.col("n_chars")), F.floor(F.col("n_chars") / 3)
    return read(spark, sf_dir, "documents").select("doc_id", F.when(a == 0, 1.0).otherwise(b / a).alias("ratio"), F.when(a == 0, 0.0).otherwise((1 - b / a) * 100).alias("saved"))


@query("SELECT item_id, to_base64(encode(text)) AS b64 FROM benchmark")
def asset_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", "").alias("b64"))


ERRORS_SQL = f"WITH {FILES_SQL}, judged AS (SELECT page_id, filename, CASE WHEN page_id % 13 = 0 THEN 'File not found' WHEN lower(filename) NOT LIKE '%.pdf' THEN 'File is not a PDF' END AS error FROM files)"


def judged_files(files: DataFrame, exists: Column) -> DataFrame:
    """One row for each input, wrong ones too: success and error."""
    error = F.when(~exists, "File not found").when(~F.lower("filename").endswith(".pdf"), "File is not a PDF")
    return files.withColumn("error", error).withColumn("success", F.col("error").isNull())


@query(f"{ERRORS_SQL} SELECT page_id, filename, error IS NULL AS success, error FROM judged")
def ingest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_files(_files(spark, sf_dir), F.col("page_id") % 13 != 0).select("page_id", "filename", "success", "error")


@query(f"{ERRORS_SQL} SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS succeeded FROM judged")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_validate(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"))


def pipe_rows(cells: Column) -> Column:
    """Pipe markdown of rows of cells: each cell stripped, nothing for null or empty; a rule of as many columns follows the first row."""
    line = lambda row: F.concat(F.lit("| "), F.array_join(F.transform(row, lambda x: F.coalesce(strip(x), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.element_at(cells, 1), lambda x: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(F.element_at(cells, 1)), rule), F.transform(F.slice(cells, 2, F.size(cells)), line)), "\n")


@query(
    "WITH w AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark), r AS (SELECT item_id, unnest(range(0, (len(ws) + 3) // 4)) AS k, ws FROM w), l AS (SELECT item_id, k, '| ' || array_to_string(list_transform(ws[k * 4 + 1 : k * 4 + 4], lambda x: trim(x)), ' | ') || ' |' AS line, least(len(ws), 4) AS n FROM r) "
    "SELECT item_id, string_agg(line || CASE WHEN k = 0 THEN chr(10) || '| ' || array_to_string(list_transform(range(0, n), lambda x: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY k) AS md FROM l GROUP BY item_id"
)
def render_pipe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each item as a table, four cells a row."""
    words = F.split("text", " ")
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 4).cast("int")), lambda k: F.slice(words, k * 4 + 1, F.lit(4)))
    return read(spark, sf_dir, "benchmark").select("item_id", pipe_rows(rows).alias("md"))
