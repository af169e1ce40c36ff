"""The map of a document: pages, sections, tables, title, contents, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pytext import FLAGS, slug, strip
from ..plans.registry import query
from ..sources.corpus import PAGES_SQL, lines, page_rows

MARKER = r"<!-- Page (\d+) -->"
#: A table: header, rule and body rows. Spark needs the possessive body, which ends recursion; it matches the same.
TABLE = r"(\|[^\n]+\|\n\|[-:\| ]+\|\n(?:\|[^\n]+\|\n?)+)"

LINES_SQL = (
    PAGES_SQL
    + r""", split_lines AS (SELECT doc_id, string_split(md, chr(10)) AS parts, md FROM corpus),
numbered_lines AS (SELECT doc_id, unnest(range(0, len(parts))) AS line_no, unnest(parts) AS line FROM split_lines),
marked AS (SELECT doc_id, line_no, line, TRY_CAST(regexp_extract(line, '<!-- Page ([0-9]+) -->', 1) AS INTEGER) AS mark,
  CASE WHEN regexp_matches(line, '^#{1,6}\s') THEN length(regexp_extract(line, '^(#{1,6})\s', 1)) END AS level FROM numbered_lines),
paged AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 1) AS page FROM marked),
heads AS (SELECT *, trim(regexp_replace(trim(regexp_extract(line, '^#{1,6}\s+(.+)$', 1)), '\*\*([^*]+)\*\*', '\1', 'g')) AS title FROM paged WHERE level IS NOT NULL),
sections AS (SELECT h.doc_id, h.title, CAST(h.level AS BIGINT) AS level, CAST(h.page AS BIGINT) AS page, CAST(h.line_no AS BIGINT) AS start_line,
  CAST(coalesce((SELECT min(g.line_no) FROM heads g WHERE g.doc_id = h.doc_id AND g.line_no > h.line_no AND g.level <= h.level), (SELECT len(s.parts) FROM split_lines s WHERE s.doc_id = h.doc_id)) AS BIGINT) AS end_line,
  'sec_' || substring(regexp_replace(lower(h.title), '[^a-z0-9]', '_', 'g'), 1, 30) AS id FROM heads h WHERE h.title <> '' AND h.mark IS NULL)
"""
)


def headed(rows: DataFrame) -> DataFrame:
    """doc_id, line_no, level, title, page, end_line of the heading lines: blank headings too, which only end sections.

    Only marker and heading lines reach the window, one for each document; for each level the next line that ends it is a running minimum
    from the document's end, since Spark sums up a frame of all following rows anew for each row.
    """
    mark = F.expr(r"try_cast(regexp_extract(line, '(?Ud)<!-- Page (\\d+) -->', 1) as int)")
    level = F.length(F.regexp_extract("line", FLAGS + r"^(#{1,6})\s", 1))
    count = rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    few = rows.select("doc_id", "line_no", "line", mark.alias("mark"), level.alias("level")).where("mark is not null or level > 0")
    by = Window.partitionBy("doc_id").orderBy("line_no")
    page = F.coalesce(F.last("mark", True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))
    after = Window.partitionBy("doc_id").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.when(F.col("level") == k, F.min(F.when((F.col("level") > 0) & (F.col("level") <= k), F.col("line_no"))).over(after)) for k in range(1, 7)]
    title = strip(F.regexp_replace(strip(F.regexp_extract("line", FLAGS + r"^#{1,6}\s+(.+)$", 1)), r"\*\*([^*]+)\*\*", "$1"))
    out = few.withColumn("page", page).withColumn("next", F.coalesce(*ends)).where("level > 0 and mark is null")
    return out.join(count, "doc_id").select("doc_id", "line_no", "level", title.alias("title"), "page", F.coalesce("next", "n_lines").alias("end_line"))


def sections(pages: DataFrame) -> DataFrame:
    h = headed(lines(pages)).where("title <> ''")
    long = lambda c: F.col(c).cast("long")
    return h.select("doc_id", "title", long("level").alias("level"), long("page").alias("page"), long("line_no").alias("start_line"), long("end_line").alias("end_line"), F.concat(F.lit("sec_"), slug(F.col("title"))).alias("id"))


def tables(pages: DataFrame) -> DataFrame:
    """doc_id, ordinal, id, page, preview, markdown, row_count, col_count of the pipe tables, in page order. The page: that of the last marker before."""
    found = pages.select("doc_id", "pg", F.posexplode(F.regexp_extract_all("t", F.lit(TABLE[:-1] + "+)"), F.lit(1))).alias("at", "markdown"))
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("pg", "at"))
    body = F.filter(F.split(strip(F.col("markdown")), "\n", -1), lambda x: strip(x) != "")
    head = F.element_at(body, 1)
    return found.select(
        "doc_id", ordinal.cast("long").alias("ordinal"), F.concat(F.lit("tab_"), ordinal).alias("id"), F.col("pg").cast("long").alias("page"),
        F.translate(F.substring("markdown", 1, 100), "\n", " ").alias("preview"), "markdown", (F.size(body) - 1).cast("long").alias("row_count"), (F.length(head) - F.length(F.translate(head, "|", "")) - 1).cast("long").alias("col_count"),
    )


def titles(pages: DataFrame) -> DataFrame:
    """The text after the first ``#`` at a line's start, else the first line with text that is no comment, cut to 100 characters, else empty.

    White space after the ``#`` may hold line feeds: a bare one takes the next line that has text. Only places of lines reach the window, no text.
    """
    rows = lines(pages).withColumn("s", strip(F.col("line")))
    full = rows.where("s <> ''").select("doc_id", "line_no", F.col("line").rlike(FLAGS + r"^#(\s|$)").alias("mark"), (F.col("s") == "#").alias("lone"), (~F.col("s").startswith("<!--")).alias("plain"))
    after = F.lead("line_no").over(Window.partitionBy("doc_id").orderBy("line_no"))
    at = full.withColumn("at", F.when(F.col("mark"), F.when(F.col("lone"), after).otherwise(F.col("line_no"))))
    pick = at.groupBy("doc_id").agg(F.min_by("at", F.when(F.col("at").isNotNull(), F.col("line_no"))).alias("h"), F.min_by("lone", F.when(F.col("at").isNotNull(), F.col("line_no"))).alias("lone"), F.min(F.when(F.col("plain"), F.col("line_no"))).alias("first"))
    place = pick.select("doc_id", F.coalesce("h", "first").alias("line_no"), F.col("h").isNotNull().alias("head"), "lone")
    text = F.when(F.col("head") & ~F.col("lone"), strip(F.regexp_extract("line", FLAGS + r"^#\s+(.+)$", 1))).when(F.col("head"), F.col("s")).otherwise(F.substring("s", 1, 100))
    found = place.join(rows.select("doc_id", "line_no", "line", "s"), ["doc_id", "line_no"]).select("doc_id", text.alias("title"))
    return pages.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("title", F.lit("")).alias("title"))


TABLES_SQL = (
    PAGES_SQL
    + r""", found AS (SELECT doc_id, pg, regexp_extract_all(t, '(\|[^\n]+\|\n\|[-:\| ]+\|\n(?:\|[^\n]+\|\n?)+)', 1) AS ts FROM page_rows),
each_table AS (SELECT doc_id, pg, unnest(range(0, len(ts))) AS place, unnest(ts) AS markdown FROM found),
tables_ AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pg, place) AS ordinal, pg AS page, markdown, length(rtrim(markdown, chr(10))) - length(replace(rtrim(markdown, chr(10)), chr(10), '')) AS row_count,
  length(split_part(markdown, chr(10), 1)) - length(replace(split_part(markdown, chr(10), 1), '|', '')) - 1 AS col_count FROM each_table)
"""
)


@query(f"WITH {LINES_SQL} SELECT * FROM sections")
def parse_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(page_rows(spark, sf_dir))


@query(f"WITH {LINES_SQL} SELECT doc_id, start_line, end_line - start_line AS n_lines, level FROM sections")
def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(page_rows(spark, sf_dir)).select("doc_id", "start_line", (F.col("end_line") - F.col("start_line")).alias("n_lines"), "level")


@query(f"WITH {LINES_SQL} SELECT doc_id, CAST(page AS BIGINT) AS page, count(*) AS n_lines FROM paged GROUP BY ALL")
def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each running page, that of the last marker before or in the line, 1 before any."""
    mark = F.expr(r"try_cast(regexp_extract(line, '(?Ud)<!-- Page (\\d+) -->', 1) as int)")
    marks = lines(page_rows(spark, sf_dir)).select("doc_id", "line_no", mark.alias("mark"))
    page = F.coalesce(F.last("mark", True).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))
    return marks.withColumn("page", page.cast("long")).groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"))


@query(f"WITH {TABLES_SQL} SELECT doc_id, 'tab_' || CAST(ordinal AS VARCHAR) AS id, page, replace(substring(markdown, 1, 100), chr(10), ' ') AS preview, row_count, col_count FROM tables_")
def parse_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(page_rows(spark, sf_dir)).select("doc_id", "id", "page", "preview", "row_count", "col_count")


def loosened(md: str) -> str:
    """SQL: the title on a later line than its ``#``, or without one, by the length of the id, so that all rules are met."""
    return f"CASE WHEN length(doc_id) % 2 = 0 THEN replace({md}, '# Source', '#  ' || chr(10) || chr(10) || ' Source') ELSE replace({md}, '# Source', 'Source') END"


@query(
    f"WITH {PAGES_SQL}, loose AS (SELECT doc_id, {loosened('md')} AS md FROM corpus), first_lines AS (SELECT doc_id, k, trim(line) AS line FROM (SELECT doc_id, unnest(range(0, len(string_split(md, chr(10))))) AS k, unnest(string_split(md, chr(10))) AS line FROM loose) x WHERE trim(line) <> '' AND NOT starts_with(trim(line), '<!--')), "
    "f AS (SELECT doc_id, substring(min_by(line, k), 1, 100) AS line FROM first_lines GROUP BY doc_id) SELECT l.doc_id, coalesce(nullif(trim(regexp_extract(md, '(?m)^#\\s+(.+)$', 1)), ''), f.line, '') AS title FROM loose l LEFT JOIN f ON l.doc_id = f.doc_id"
)
def doc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of documents whose heading's text is on a later line, or which have no heading."""
    return titles(page_rows(spark, sf_dir).withColumn("t", F.expr(loosened("t").replace("chr(10)", "'\\n'"))))


@query(f"WITH {LINES_SQL} SELECT doc_id, string_agg(title, ' / ' ORDER BY start_line) AS toc FROM sections WHERE level <= 2 GROUP BY doc_id")
def doc_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = parse_sections(spark, sf_dir).where("level <= 2")
    return s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "title"))), lambda x: x.title), " / ").alias("toc"))


SUMMARY_SQL = f"""WITH {LINES_SQL}, found AS (SELECT doc_id, len(regexp_extract_all(t, '(\\|[^\\n]+\\|\\n\\|[-:\\| ]+\\|\\n(?:\\|[^\\n]+\\|\\n?)+)', 1)) AS k FROM page_rows),
summary AS (SELECT c.doc_id, c.pages, (SELECT CAST(sum(k) AS BIGINT) FROM found f WHERE f.doc_id = c.doc_id) AS tables, (SELECT count(*) FROM sections s WHERE s.doc_id = c.doc_id) AS sections FROM corpus c)"""


def summary(pages: DataFrame) -> DataFrame:
    n = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.size(F.regexp_extract_all("t", F.lit(TABLE[:-1] + "+)"), F.lit(1)))).cast("long").alias("tables"))
    return n.join(sections(pages).groupBy("doc_id").agg(F.count("*").alias("sections")), "doc_id", "left").na.fill(0, ["sections"])


@query(f"{SUMMARY_SQL} SELECT * FROM summary")
def doc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(page_rows(spark, sf_dir))


@query(f"{SUMMARY_SQL} SELECT doc_id, substring(doc_id, 5) || '.pdf' AS filename, pages, tables, sections, CAST(0 AS BIGINT) AS figures FROM summary")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_summary(spark, sf_dir).select("doc_id", F.concat(F.substring("doc_id", 5, 1000), F.lit(".pdf")).alias("filename"), "pages", "tables", "sections", F.lit(0).cast("long").alias("figures"))


@query(f"{SUMMARY_SQL} SELECT * FROM summary WHERE doc_id = 'doc_src3'")
def manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(page_rows(spark, sf_dir).where("doc_id = 'doc_src3'"))


@query(f"WITH {LINES_SQL} SELECT doc_id, start_line, repeat('  ', CAST(level - 1 AS INTEGER)) || '- ' || title AS entry FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS k FROM sections) s WHERE k <= 15")
def doc_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 entries of each document's outline, indented by level."""
    s = parse_sections(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("start_line"))).where("k <= 15")
    return s.select("doc_id", "start_line", F.concat(F.expr("repeat('  ', cast(level - 1 as int))"), F.lit("- "), "title").alias("entry"))


@query(
    f"""WITH {LINES_SQL}{TABLES_SQL[len(PAGES_SQL):]}, titled AS (SELECT doc_id, coalesce(trim(min_by(regexp_extract(line, '^#\\s+(.+)$', 1), CASE WHEN regexp_matches(line, '^#\\s+.+$') THEN line_no END)), '') AS title FROM numbered_lines GROUP BY doc_id),
s AS (SELECT doc_id, list({{'start_line': start_line, 'end_line': end_line, 'id': id, 'title': title, 'level': level, 'page': page}} ORDER BY start_line) AS items FROM sections GROUP BY doc_id),
t AS (SELECT doc_id, list({{'ordinal': ordinal, 'id': 'tab_' || ordinal, 'page': page, 'preview': replace(substring(markdown, 1, 100), chr(10), ' '), 'row_count': row_count, 'col_count': col_count}} ORDER BY ordinal) AS items FROM tables_ GROUP BY doc_id)
SELECT d.doc_id, CAST(to_json({{'doc_id': d.doc_id, 'title': d.title, 'assets': {{'sections': coalesce(s.items, []), 'tables': coalesce(t.items, [])}}}}) AS VARCHAR) AS manifest FROM titled d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""
)
def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the manifest as JSON, its sections and tables nested; a document without them has empty lists."""
    pages = page_rows(spark, sf_dir)
    s = sections(pages).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "id", "title", "level", "page"))).alias("sections"))
    t = tables(pages).drop("markdown").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", "page", "preview", "row_count", "col_count"))).alias("tables"))
    m = titles(pages).join(s, "doc_id", "left").join(t, "doc_id", "left").withColumns({c: F.coalesce(c, F.array()) for c in ("sections", "tables")})
    return m.select("doc_id", F.to_json(F.struct("doc_id", "title", F.struct("sections", "tables").alias("assets"))).alias("manifest"))


@query(f"WITH {TABLES_SQL} SELECT doc_id, ordinal, md5(markdown) AS digest FROM tables_ WHERE ordinal = 2")
def fetch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table tab_2 of each document."""
    return tables(page_rows(spark, sf_dir)).where("id = 'tab_2'").select("doc_id", "ordinal", F.md5("markdown").alias("digest"))


@query(f"WITH {LINES_SQL}, wanted AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS k FROM sections WHERE lower(id) = 'sec_part_2' OR lower(title) = 'part 2') SELECT w.doc_id, w.id, md5(array_to_string(s.parts[w.start_line + 1 : w.end_line], chr(10))) AS digest FROM wanted w JOIN split_lines s ON w.doc_id = s.doc_id WHERE k = 1")
def fetch_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section asked for as PART 2, by id or title in any case, first in page order; its lines joined again."""
    pages = page_rows(spark, sf_dir)
    pick = sections(pages).where("lower(title) = lower('PART 2') or lower(id) = 'sec_part_2'").groupBy("doc_id").agg(F.min_by(F.struct("id", "start_line", "end_line"), "start_line").alias("s"))
    rows = lines(pages).join(pick, "doc_id").where("line_no >= s.start_line and line_no < s.end_line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n")
    return rows.groupBy("doc_id", F.col("s.id").alias("id")).agg(F.md5(text).alias("digest"))


@query(f"WITH {PAGES_SQL} SELECT doc_id, 'full' AS asset_id, nullif(md, '') IS NOT NULL AS success, length(md) // 4 AS tokens FROM corpus")
def fetch_full_text(spark: SparkSession, sf_dir: str, doc_ids: list[str] | None = None) -> DataFrame:
    """The full text's row of each document, or of those asked for; an empty text is missing. Its length is the pages' and the line feeds' between them, so no document is put together."""
    pages = page_rows(spark, sf_dir)
    asked = pages.where(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else pages
    n = asked.groupBy("doc_id").agg((F.coalesce(F.sum(F.length("t")), F.lit(0)) + F.greatest(F.count("t") - 1, F.lit(0))).alias("n"))
    return n.select("doc_id", F.lit("full").alias("asset_id"), (F.col("n") > 0).alias("success"), F.floor(F.col("n") / 4).alias("tokens"))


REQUESTS = "(VALUES ('doc_src1','table','tab_1'),('doc_src1','table','tab_9999'),('doc_src2','section','SOURCE SRC2'),('doc_src2','section','nope'),('doc_src3','full_text','full'),('doc_none','table','tab_1'),('doc_src3','video','x')) AS r(doc_id, asset_type, asset_id)"


@query(
    f"WITH {LINES_SQL}, found AS (SELECT doc_id, len(regexp_extract_all(t, '(\\|[^\\n]+\\|\\n\\|[-:\\| ]+\\|\\n(?:\\|[^\\n]+\\|\\n?)+)', 1)) AS k FROM page_rows), counts AS (SELECT doc_id, sum(k) AS n FROM found GROUP BY doc_id) "
    f"SELECT r.doc_id, r.asset_type, r.asset_id, CASE WHEN r.asset_type NOT IN ('table', 'figure', 'section', 'full_text') THEN 'Invalid asset type' WHEN c.doc_id IS NULL THEN 'Document not found' "
    f"WHEN r.asset_type = 'table' AND NOT coalesce(TRY_CAST(substring(r.asset_id, 5) AS BIGINT) BETWEEN 1 AND c.n, false) THEN 'Table not found' "
    f"WHEN r.asset_type = 'section' AND NOT EXISTS (SELECT 1 FROM sections s WHERE s.doc_id = r.doc_id AND (lower(s.id) = lower(r.asset_id) OR lower(s.title) = lower(r.asset_id))) THEN 'Section not found' END AS error FROM {REQUESTS} LEFT JOIN counts c ON r.doc_id = c.doc_id"
)
def fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests routed by type; what fails is a row with its error."""
    asked = spark.sql(f"SELECT * FROM {REQUESTS}")
    pages = page_rows(spark, sf_dir).join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    known = pages.select("doc_id").distinct().withColumn("known", F.lit(True))
    t = tables(pages).select("doc_id", F.lit("table").alias("asset_type"), F.col("id").alias("key"))
    s = sections(pages).select("doc_id", F.lit("section").alias("asset_type"), F.explode(F.array(F.lower("id"), F.lower("title"))).alias("key"))
    assets = t.unionByName(s).distinct().withColumn("hit", F.lit(True))
    key = F.when(F.col("asset_type") == "section", F.lower("asset_id")).otherwise(F.col("asset_id"))
    out = asked.withColumn("key", key).join(known, "doc_id", "left").join(assets, ["doc_id", "asset_type", "key"], "left")
    error = (
        F.when(~F.col("asset_type").isin("table", "figure", "section", "full_text"), "Invalid asset type").when(F.col("known").isNull(), "Document not found")
        .when((F.col("asset_type") == "table") & F.col("hit").isNull(), "Table not found").when((F.col("asset_type") == "section") & F.col("hit").isNull(), "Section not found")
    )
    return out.select("doc_id", "asset_type", "asset_id", error.alias("error"))


@query(f"WITH {LINES_SQL}, t AS (SELECT * FROM numbered_lines WHERE line LIKE '| ---%') SELECT t.doc_id, CAST(t.line_no AS BIGINT) AS line_no, CAST((SELECT max(m.mark) FROM marked m WHERE m.doc_id = t.doc_id AND m.line_no <= t.line_no) AS BIGINT) AS page FROM t")
def page_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each table rule line: the last marker at or before it, as of its line number."""
    rows = lines(page_rows(spark, sf_dir)).select("doc_id", "line_no", F.expr(r"try_cast(regexp_extract(line, '<!-- Page ([0-9]+) -->', 1) as bigint)").alias("mark"), F.col("line").startswith("| ---").alias("rule")).where("rule or mark is not null")
    by = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("page", F.last("mark", True).over(by)).where("rule").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "page")
