"""Chunks for retrieval: basic, by paragraphs, by headings, by pages, and the router between them.

All are column expressions over one text, so a document is cut where it lies, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pytext import strip
from ..plans.registry import query, read
from ..sources.corpus import PAGES_SQL, page_rows
from .scalars import PRESETS, doc_type, kind_sql

#: Characters that end a sentence; what begins a section; a page marker.
TERMINATORS = ".。!?！？"
HEADING = r"(?:#{1,6}(?U:\s)+[^\n]+|[A-Z][A-Z\s\x0B]{5,50}(?=\n|\z)|\p{Nd}+\.(?U:\s)+[A-Z][^\n]{5,50}(?=\n|\z))"
PAGE = r"<!--\s*Page\s+(\d+)\s*-->"
SPAN = "array<struct<start:int,len:int>>"


def check(size: int, overlap: int) -> None:
    """Overlaps that would keep the cursor in place are refused."""
    if not 0 <= overlap < int(0.8 * size) + 1:
        raise ValueError(f"chunk_overlap must be under {int(0.8 * size) + 1} for chunk_size {size}")


def basic(text: Column, size: int, overlap: int, least: int, sentences: bool = True) -> Column:
    """Spans (start, len) of the greedy cutter: ``size`` characters, or less where a sentence ends in the last fifth."""
    check(size, overlap)
    n, cut = F.length(text), int(size * 0.8)
    steps = F.sequence(F.lit(1), F.floor(n / (cut + 1 - overlap)).cast("int") + 2)

    def step(a, _):
        # Each is computed once a step, by way of an array of one element: how far the last sentence reaches into the tail, then how far the chunk does.
        s, n = a["s"], a["n"]
        reach = F.transform(F.array(F.substring(text, s + cut + 1, F.lit(size - cut))), lambda t: F.length(F.regexp_extract(t, f"(?s)^(.*[{TERMINATORS}])", 1)) if sentences else F.lit(0))

        def move(end):
            long, last = F.when(end > 0, end + cut).otherwise(size), s + size >= n
            took = F.when(last, n - s).otherwise(long)
            out = F.when(took >= least, F.concat(a["out"], F.array(F.struct(s.alias("start"), took.cast("int").alias("len"))))).otherwise(a["out"])
            return F.struct((s + long - overlap).cast("int").alias("s"), last.alias("done"), n.alias("n"), out.cast(SPAN).alias("out"))

        return F.when(a["done"], a).otherwise(F.element_at(F.transform(reach, move), 1))

    zero = F.struct(F.lit(0).alias("s"), F.lit(False).alias("done"), n.alias("n"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(steps, zero, step, lambda a: a["out"])


def basic_chunks(text: Column, size: int, overlap: int, least: int) -> Column:
    """`basic` as (page, heading, text), both without value."""
    return F.transform(spans_text(text, basic(text, size, overlap, least)), lambda t: F.struct(F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("heading"), t.alias("text")))


def semantic_chunks(text: Column, size: int, overlap: int, least: int) -> Column:
    """`semantic` as (page, heading, text), the page without value."""
    return F.transform(semantic(text, size, overlap, least), lambda c: F.struct(F.lit(None).cast("int").alias("page"), c["heading"].alias("heading"), c["text"].alias("text")))


def spans_text(text: Column, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.substring(text, x["start"] + 1, x["len"]))


def paragraphs(text: Column, size: int, overlap: int, least: int) -> Column:
    """Texts of merged paragraphs; each begins with the last ``overlap`` characters of the one before."""
    parts = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda x: x != "")
    gap = F.lit("\n\n")

    def step(a, p):
        cur = a["cur"]
        full = F.length(cur) + F.length(p) + 2 > size
        out = F.when(full & (F.length(cur) >= least), F.concat(a["out"], F.array(cur))).otherwise(a["out"])
        carried = F.when((F.lit(overlap) > 0) & (cur != ""), F.concat(F.right(cur, F.lit(overlap)), gap, p)).otherwise(p)
        grown = F.when(cur != "", F.concat(cur, gap, p)).otherwise(p)
        return F.struct(F.when(full, carried).otherwise(grown).alias("cur"), out.alias("out"))

    zero = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(parts, zero, step, lambda a: F.when(F.length(a["cur"]) >= least, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))


def headings(text: Column) -> Column:
    """(heading, text) sections: each begins with a heading line's match; what stands before the first has heading ''."""
    marked = F.split(F.regexp_replace(text, f"(?<=^|\\n)({HEADING})", "\x01$1"), "\x01", -1)
    some = F.filter(marked, lambda x, k: (k > 0) | (F.length(x) > 0) | (F.size(marked) == 1))
    first_plain = ~F.startswith(F.regexp_replace(text, f"(?<=^|\\n)({HEADING})", "\x01$1"), F.lit("\x01"))
    return F.transform(some, lambda x, k: F.struct(F.when((k == 0) & first_plain, "").otherwise(F.substring(strip(F.regexp_extract(x, f"^({HEADING})", 1)), 1, 50)).alias("heading"), x.alias("text")))


CHUNK = "array<struct<heading:string,text:string>>"


def semantic(text: Column, size: int, overlap: int, least: int) -> Column:
    """Sections that fit whole, larger ones by paragraphs; a section that stays one oversized chunk is cut by `basic`. Small ones under ``least`` are dropped."""

    def cut(s):
        named = lambda texts: F.transform(texts, lambda t: F.struct(s["heading"].alias("heading"), t.alias("text")))
        whole = F.when(F.length(s["text"]) >= least, F.array(s)).otherwise(F.array().cast(CHUNK))
        parts = paragraphs(s["text"], size, overlap, least)
        one = (F.size(parts) == 1) & (F.length(F.get(parts, F.lit(0))) > size)
        return F.when(F.length(s["text"]) <= size, whole).when(one, named(spans_text(s["text"], basic(s["text"], size, overlap, least)))).otherwise(named(parts))

    return F.flatten(F.transform(headings(text), cut))


def page_aware(text: Column, size: int, overlap: int, least: int) -> Column:
    """(page, heading, text): pages that fit whole, larger ones by `semantic`; text before the first marker is discarded; no markers: `semantic` of all."""
    numbers = F.regexp_extract_all(text, F.lit(PAGE), F.lit(1))
    bodies = F.slice(F.split(text, PAGE, -1), F.lit(2), F.size(numbers) + 1)

    def cut(b, k):
        page = F.get(numbers, k).cast("int")
        body = strip(b)
        named = lambda chunks: F.transform(chunks, lambda c: F.struct(page.alias("page"), c["heading"].alias("heading"), c["text"].alias("text")))
        whole = F.array(F.struct(F.lit(None).cast("string").alias("heading"), body.alias("text"))).cast(CHUNK)
        small = F.when(F.length(body) >= least, whole).otherwise(F.array().cast(CHUNK))
        return named(F.when(F.length(body) <= size, small).otherwise(semantic(body, size, overlap, least)))

    plain = F.transform(semantic(text, size, overlap, least), lambda c: F.struct(F.lit(None).cast("int").alias("page"), c["heading"].alias("heading"), c["text"].alias("text")))
    return F.when(F.size(numbers) > 0, F.flatten(F.transform(bodies, cut))).otherwise(plain)


def smart(docs: DataFrame, text: str = "text", filename: str = "filename", strategy: str = "auto", custom: tuple[int, int, int] | None = None) -> DataFrame:
    """doc_id, kind, index, page, heading, chunk: each document's type picks its preset, or ``custom`` (size, overlap, least) holds for all; ``auto`` is by pages where a marker stands, else semantic; an unknown strategy is semantic."""
    from ..plans.extensions import chunker

    kinds = docs.select("doc_id", F.col(text).alias("text"), doc_type(F.col(text), F.col(filename)).alias("kind"))
    cutter = chunker("page_aware" if strategy == "auto" else strategy)
    cut = F.lit(None).cast("array<struct<page:int,heading:string,text:string>>")
    for kind, (size, overlap) in PRESETS.items():
        cut = F.when(F.col("kind") == kind, cutter(F.col("text"), *(custom or (size, overlap, 100)))).otherwise(cut)
    out = kinds.select("doc_id", "kind", F.posexplode(cut).alias("index", "c"))
    return out.select("doc_id", "kind", "index", F.col("c.page").alias("page"), F.col("c.heading").alias("heading"), F.col("c.text").alias("chunk"))


def located(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """``chunks`` (doc_id, index, chunk, ...) with start_char and end_char: where each stands in its document, the first place not before the chunk before it; null for a chunk that overlap or joined paragraphs made, which stands nowhere as it is."""
    from pyspark.sql import Window

    found = chunks.join(docs.select("doc_id", "text"), "doc_id").withColumn("at", F.expr("instr(text, chunk)"))
    start = F.when(F.col("at") > 0, F.col("at") - 1)
    before = F.max("at").over(Window.partitionBy("doc_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1))
    later = F.expr("locate(chunk, text, greatest(coalesce(before, 0), 1))")
    placed = found.withColumn("before", before).withColumn("start_char", F.when(later > 0, later - 1).otherwise(start))
    return placed.withColumn("end_char", F.col("start_char") + F.length("chunk")).drop("text", "at", "before")


BASIC_SQL = """WITH RECURSIVE walk AS (
  SELECT doc_id, text, length(text) AS n, 0 AS s, false AS done, -1 AS start, 0 AS len FROM documents
  UNION ALL
  SELECT doc_id, text, n, CASE WHEN s + 1000 >= n THEN s ELSE s + e - 200 END, s + 1000 >= n, s, CASE WHEN s + 1000 >= n THEN n - s ELSE e END
  FROM (SELECT *, CASE WHEN length(regexp_extract(substring(text, s + 801, 200), '(?s)^(.*[.。!?！？])', 1)) > 0 THEN 800 + length(regexp_extract(substring(text, s + 801, 200), '(?s)^(.*[.。!?！？])', 1)) ELSE 1000 END AS e FROM walk WHERE NOT done) w)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(len AS BIGINT) AS len, md5(substring(text, start + 1, len)) AS digest FROM walk WHERE start >= 0 AND len >= 100"""


@query(BASIC_SQL)
def chunk_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.explode(basic(F.col("text"), 1000, 200, 100)).alias("c"))
    return d.select("doc_id", F.col("c.start").cast("long").alias("start"), F.col("c.len").cast("long").alias("len"), F.md5(F.substring("text", F.col("c.start") + 1, F.col("c.len"))).alias("digest"))


PARAGRAPHS_SQL = """WITH RECURSIVE parts AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS k, unnest(ps) AS p, len(ps) AS n FROM (SELECT doc_id, string_split(trim(replace(text, chr(10), chr(10) || chr(10))), chr(10) || chr(10)) AS ps FROM documents) s),
clean AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k, trim(p) AS p FROM parts WHERE trim(p) <> ''),
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS k, '' AS cur, '' AS done FROM documents
  UNION ALL
  SELECT w.doc_id, c.k, CASE WHEN length(cur) + length(p) + 2 > 1000 THEN CASE WHEN cur <> '' THEN right(cur, 200) || chr(10) || chr(10) || p ELSE p END WHEN cur <> '' THEN cur || chr(10) || chr(10) || p ELSE p END,
    CASE WHEN length(cur) + length(p) + 2 > 1000 AND length(cur) >= 100 THEN cur ELSE '' END FROM walk w JOIN clean c ON w.doc_id = c.doc_id AND c.k = w.k + 1),
outs AS (SELECT doc_id, k, done AS t FROM walk WHERE done <> '' UNION ALL SELECT doc_id, k + 1, cur FROM walk w WHERE length(cur) >= 100 AND k = (SELECT max(k) FROM walk x WHERE x.doc_id = w.doc_id))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS index, CAST(length(t) AS BIGINT) AS n, md5(t) AS digest FROM outs"""


@query(PARAGRAPHS_SQL)
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(paragraphs(text, 1000, 200, 100)).alias("index", "t"))
    return d.select("doc_id", F.col("index").cast("long").alias("index"), F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query(
    f"WITH {PAGES_SQL}, rows_ AS (SELECT doc_id, pg, unnest(range(0, len(string_split(t, chr(10))))) AS k, unnest(string_split(t, chr(10))) AS line FROM page_rows) "
    "SELECT doc_id, pg AS page, trim(substring(line, 1, 50)) AS heading FROM rows_ WHERE regexp_matches(line, '^#{1,6}\\s+.+')"
)
def split_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown headings that begin a section, by page."""
    h = page_rows(spark, sf_dir).select("doc_id", F.col("pg").cast("long").alias("page"), F.explode(headings(F.col("t"))).alias("s"))
    return h.where(F.col("s.heading").startswith("#")).select("doc_id", "page", F.col("s.heading").alias("heading"))


def semantic_sql(source: str) -> str:
    """CTEs after ``source`` (doc_id, pg, x, size, overlap) that end in cut_ (doc_id, pg, sec, k, heading, t): `semantic` with at least 100 characters."""
    heading = r"(#{1,6}\s+[^\n]+|[A-Z][A-Z\s\x0B]{5,50}$|\p{Nd}+\.\s+[A-Z][^\n]{5,50}$)"
    stop = "length(regexp_extract(substring(x, s + cut + 1, size - cut), '(?s)^(.*[.。!?！？])', 1))"
    return rf"""{source},
split_ AS (SELECT *, string_split(regexp_replace(x, '(?m)^{heading}', chr(1) || '\1', 'g'), chr(1)) AS ps FROM source),
pieces AS (SELECT doc_id, pg, size, overlap, ps, unnest(range(1, len(ps) + 1)) AS sec, unnest(ps) AS x FROM split_),
secs AS (SELECT doc_id, pg, size, overlap, CAST(floor(size * 0.8) AS INTEGER) AS cut, sec, x, CASE WHEN sec = 1 THEN '' ELSE substring(trim(regexp_extract(x, '(?m)^{heading}', 1)), 1, 50) END AS heading FROM pieces WHERE sec > 1 OR x <> '' OR len(ps) = 1),
big AS (SELECT * FROM secs WHERE length(x) > size),
paras AS (SELECT doc_id, pg, sec, row_number() OVER (PARTITION BY doc_id, pg, sec ORDER BY k) AS k, p FROM (SELECT doc_id, pg, sec, k, regexp_replace(p, '^\s+|\s+$', '', 'g') AS p FROM (SELECT doc_id, pg, sec, unnest(range(1, len(ps) + 1)) AS k, unnest(ps) AS p FROM (SELECT *, regexp_split_to_array(x, '\n\s*\n') AS ps FROM big) b) q) r WHERE p <> ''),
merge_ AS (SELECT doc_id, pg, sec, size, overlap, CAST(0 AS BIGINT) AS k, '' AS cur, '' AS done FROM big
  UNION ALL SELECT w.doc_id, w.pg, w.sec, size, overlap, c.k,
    CASE WHEN cur = '' THEN p WHEN length(cur) + length(p) + 2 > size THEN right(cur, overlap) || chr(10) || chr(10) || p ELSE cur || chr(10) || chr(10) || p END,
    CASE WHEN length(cur) + length(p) + 2 > size AND length(cur) >= 100 THEN cur ELSE '' END
  FROM merge_ w JOIN paras c ON w.doc_id = c.doc_id AND w.pg = c.pg AND w.sec = c.sec AND c.k = w.k + 1),
ends AS (SELECT doc_id, pg, sec, max(k) AS k FROM merge_ GROUP BY ALL),
merged AS (SELECT doc_id, pg, sec, k, done AS t FROM merge_ WHERE done <> '' UNION ALL SELECT m.doc_id, m.pg, m.sec, m.k + 1, m.cur FROM merge_ m JOIN ends e ON m.doc_id = e.doc_id AND m.pg = e.pg AND m.sec = e.sec AND m.k = e.k WHERE length(m.cur) >= 100),
lone AS (SELECT b.* FROM big b JOIN (SELECT doc_id, pg, sec, count(*) AS n, max(length(t)) AS long FROM merged GROUP BY ALL) m ON b.doc_id = m.doc_id AND b.pg = m.pg AND b.sec = m.sec WHERE n = 1 AND long > size),
walk AS (SELECT doc_id, pg, sec, x, size, overlap, cut, 0 AS s, false AS over_, -1 AS start, 0 AS len FROM lone
  UNION ALL SELECT doc_id, pg, sec, x, size, overlap, cut, CASE WHEN s + size >= length(x) THEN s ELSE s + e - overlap END, s + size >= length(x), s, CASE WHEN s + size >= length(x) THEN length(x) - s ELSE e END
  FROM (SELECT *, CASE WHEN {stop} > 0 THEN cut + {stop} ELSE size END AS e FROM walk WHERE NOT over_) w),
cut_ AS (SELECT doc_id, pg, sec, 0 AS k, heading, x AS t FROM secs WHERE length(x) BETWEEN 100 AND size
  UNION ALL SELECT m.doc_id, m.pg, m.sec, m.k, b.heading, m.t FROM merged m JOIN big b ON m.doc_id = b.doc_id AND m.pg = b.pg AND m.sec = b.sec WHERE NOT EXISTS (SELECT 1 FROM lone l WHERE l.doc_id = m.doc_id AND l.pg = m.pg AND l.sec = m.sec)
  UNION ALL SELECT w.doc_id, w.pg, w.sec, w.start, l.heading, substring(w.x, w.start + 1, w.len) FROM walk w JOIN lone l ON w.doc_id = l.doc_id AND w.pg = l.pg AND w.sec = l.sec WHERE w.start >= 0 AND w.len >= 100)"""


#: Pages whole where they fit, else by sections: texts without their marker, as every given page has one.
BODY = r"regexp_replace(regexp_replace(t, '(?s)^.*?<!--\s*Page\s+\d+\s*-->', ''), '^\s+|\s+$', '', 'g')"
BY_PAGE = ", paged_ AS (SELECT doc_id, pg, CAST(0 AS BIGINT) AS sec, 0 AS k, CAST(NULL AS VARCHAR) AS heading, x AS t FROM bodies WHERE length(x) BETWEEN 100 AND size UNION ALL SELECT * FROM cut_)"


@query(f"WITH RECURSIVE {PAGES_SQL}, {semantic_sql('source AS (SELECT doc_id, pg, t AS x, 1000 AS size, 200 AS overlap FROM page_rows)')} SELECT doc_id, pg, row_number() OVER (PARTITION BY doc_id, pg ORDER BY sec, k) - 1 AS index, heading, md5(t) AS digest FROM cut_")
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = page_rows(spark, sf_dir).select("doc_id", F.col("pg").cast("long").alias("pg"), F.posexplode(semantic(F.col("t"), 1000, 200, 100)).alias("index", "c"))
    return d.select("doc_id", "pg", F.col("index").cast("long").alias("index"), F.col("c.heading").alias("heading"), F.md5("c.text").alias("digest"))


@query(f"WITH RECURSIVE {PAGES_SQL}, bodies AS (SELECT doc_id, pg, {BODY} AS x, 1000 AS size, 200 AS overlap FROM page_rows), {semantic_sql('source AS (SELECT * FROM bodies WHERE length(x) > size)')}{BY_PAGE} SELECT doc_id, row_number() OVER (PARTITION BY doc_id, pg ORDER BY sec, k) - 1 AS index, pg AS page, heading, md5(t) AS digest FROM paged_")
def chunk_page_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = page_rows(spark, sf_dir).select("doc_id", F.posexplode(page_aware(F.col("t"), 1000, 200, 100)).alias("index", "c"))
    return d.select("doc_id", F.col("index").cast("long").alias("index"), F.col("c.page").cast("long").alias("page"), F.col("c.heading").alias("heading"), F.md5("c.text").alias("digest"))


PRESET_SQL = " ".join(f"WHEN '{kind}' THEN {{0}}[{k + 1}]" for k, kind in enumerate(PRESETS))
KINDS_SQL = (
    "kinds AS (SELECT doc_id, pg, t, " + kind_sql("t") + " AS kind FROM page_rows), bodies AS (SELECT doc_id, pg, kind, " + BODY + " AS x, CASE kind "
    + PRESET_SQL.format([size for size, _ in PRESETS.values()]) + " END AS size, CASE kind " + PRESET_SQL.format([overlap for _, overlap in PRESETS.values()]) + " END AS overlap FROM kinds)"
)


@query(f"WITH RECURSIVE {PAGES_SQL}, {KINDS_SQL}, {semantic_sql('source AS (SELECT doc_id, pg, x, size, overlap FROM bodies WHERE length(x) > size)')}{BY_PAGE} SELECT p.doc_id, b.kind, row_number() OVER (PARTITION BY p.doc_id, p.pg ORDER BY sec, k) - 1 AS index, p.pg AS page, heading, md5(t) AS chunk FROM paged_ p JOIN bodies b ON p.doc_id = b.doc_id AND p.pg = b.pg")
def chunk_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = page_rows(spark, sf_dir).select("doc_id", F.col("t").alias("text"), F.lit("paper.pdf").alias("filename"))
    return smart(d).withColumns({"chunk": F.md5("chunk"), "index": F.col("index").cast("long"), "page": F.col("page").cast("long")})
