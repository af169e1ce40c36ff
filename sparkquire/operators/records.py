"""User-declared tables: validated appends, edits by position, previews, estimates, drafts.

A table is rows (table_id, idx, name, size, kind); an edit is a function from
DataFrame to DataFrame, and a table that several edits touch is written anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pytext import json_string
from ..plans.registry import query, read
from ..sources.sheet import xlsx

COLUMNS = (("Name", "text", True, ()), ("Size", "number", True, ()), ("Kind", "enum", False, ("ECONOMY", "SMALL", "MEDIUM", "LARGE")))


def errors(row: Column, columns=COLUMNS) -> Column:
    """All messages of a VARIANT row, in order: unknown columns, then for each column missing, no number, not allowed. Booleans count as numbers."""
    keys = F.map_keys(F.from_json(F.to_json(row), "map<string,string>"))
    out = [F.transform(F.array_except(keys, F.array(*(F.lit(c[0]) for c in columns))), lambda k: F.concat(F.lit("Unknown column: '"), k, F.lit("'")))]
    for name, kind, required, allowed in columns:
        value = F.try_variant_get(row, f"$.{name}", "string")
        what = F.schema_of_variant(F.try_variant_get(row, f"$.{name}", "variant"))
        bad = F.lit(None).cast("string")
        if kind == "number":
            bad = F.when(value.isNotNull() & ~what.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"), f"Column '{name}' must be a number")
        elif kind == "enum" and allowed:
            bad = F.when(value.isNotNull() & ~value.isin(*allowed), F.concat(F.lit(f"Invalid value for enum column '{name}': '"), value, F.lit("'")))
        missing = F.when(value.isNull(), f"Missing required column: '{name}'") if required else F.lit(None).cast("string")
        out.append(F.array(F.coalesce(missing, bad)))
    return F.filter(F.flatten(F.array(*out)), lambda x: x.isNotNull())


BATCH_SQL = """batch AS (SELECT p_partkey AS k, p_brand AS table_id,
  CASE WHEN p_partkey % 11 = 0 THEN ['Unknown column: ''Extra'''] ELSE [] END || CASE WHEN p_partkey % 5 = 0 THEN ['Missing required column: ''Name'''] ELSE [] END
  || CASE WHEN p_partkey % 7 = 0 THEN ['Column ''Size'' must be a number'] ELSE [] END || CASE WHEN p_type NOT IN ('ECONOMY', 'SMALL', 'MEDIUM', 'LARGE') THEN ['Invalid value for enum column ''Kind'': ''' || p_type || ''''] ELSE [] END AS errs FROM part)"""


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, table_id, row: proposed rows made of ``part``, some of them wrong."""
    k = F.col("p_partkey")
    fields = F.concat_ws(
        ",", F.when(k % 5 != 0, F.concat(F.lit('"Name":'), json_string(F.col("p_name")))), F.concat(F.lit('"Size":'), F.when(k % 7 == 0, '"big"').otherwise(F.col("p_size").cast("string"))),
        F.concat(F.lit('"Kind":'), json_string(F.col("p_type"))), F.when(k % 11 == 0, '"Extra":1'),
    )
    return read(spark, sf_dir, "part").select(k.alias("k"), F.col("p_brand").alias("table_id"), F.parse_json(F.concat(F.lit("{"), fields, F.lit("}"))).alias("row"))


@query(f"WITH {BATCH_SQL} SELECT k, array_to_string(errs, '; ') AS errors FROM batch")
def a2t_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).select("k", F.array_join(errors(F.col("row")), "; ").alias("errors"))


@query(f"WITH {BATCH_SQL} SELECT table_id, count(*) FILTER (len(errs) = 0) AS added, count(*) FILTER (len(errs) > 0) AS rejected, count(*) FILTER (len(errs) = 0) > 0 AS success FROM batch GROUP BY table_id")
def a2t_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row is judged alone: good ones are added, bad ones reported."""
    b = _batch(spark, sf_dir).withColumn("bad", F.size(errors(F.col("row"))) > 0)
    return b.groupBy("table_id").agg(F.count_if(~F.col("bad")).alias("added"), F.count_if("bad").alias("rejected")).withColumn("success", F.col("added") > 0)


ROWS_SQL = "rows_ AS (SELECT p_brand AS table_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS idx, p_name AS name, p_size AS size, p_type AS kind FROM part)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).cast("long")
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("table_id"), idx.alias("idx"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"))


def replaced(rows: DataFrame, table_id: str, idx: int, **values) -> DataFrame:
    """``rows`` with some columns of one row given anew."""
    here = (F.col("table_id") == table_id) & (F.col("idx") == idx)
    return rows.withColumns({c: F.when(here, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def deleted(rows: DataFrame, table_id: str, idx: int) -> DataFrame:
    """``rows`` without one, those after it moved up."""
    here = F.col("table_id") == table_id
    return rows.where(~(here & (F.col("idx") == idx))).withColumn("idx", F.when(here & (F.col("idx") > idx), F.col("idx") - 1).otherwise(F.col("idx")))


def appended(rows: DataFrame, more: DataFrame) -> DataFrame:
    """``rows`` and after each table's last row those of ``more`` (table_id, at, other columns), in the order of ``at``."""
    last = rows.groupBy("table_id").agg((F.max("idx") + 1).alias("base"))
    place = F.row_number().over(Window.partitionBy("table_id").orderBy("at")) - 1
    placed = more.join(last, "table_id", "left").withColumn("idx", F.coalesce("base", F.lit(0)) + place).drop("base", "at")
    return rows.unionByName(placed.withColumn("idx", F.col("idx").cast(rows.schema["idx"].dataType)).select(*rows.columns))


@query(f"WITH {ROWS_SQL} SELECT table_id, idx, CASE WHEN idx = 3 AND table_id = 'Brand#2' THEN 'new' ELSE name END AS name, CASE WHEN idx = 3 AND table_id = 'Brand#2' THEN 7 ELSE size END AS size FROM rows_")
def a2t_update_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(_rows(spark, sf_dir), "Brand#2", 3, name="new", size=7).select("table_id", "idx", "name", "size")


@query(f"WITH {ROWS_SQL} SELECT table_id, CASE WHEN table_id = 'Brand#2' AND idx > 3 THEN idx - 1 ELSE idx END AS idx, name FROM rows_ WHERE NOT (table_id = 'Brand#2' AND idx = 3)")
def a2t_delete_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted(_rows(spark, sf_dir), "Brand#2", 3).select("table_id", "idx", "name")


CELL_SQL = "asked AS (SELECT table_id, max(idx) AS last, CASE WHEN substring(table_id, 7, 1) = '1' THEN 9999 ELSE 1 END AS idx, CASE WHEN substring(table_id, 7, 1) = '3' THEN 'Colour' ELSE 'Kind' END AS col FROM rows_ GROUP BY table_id)"


def cells_updated(rows: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after, outcomes): each of ``asked`` (table_id, idx, col, value) sets one cell to a text, whatever the column's type; one at most for each cell.

    An outcome is table_id, idx, col, success, error, old_value, new_value; an index out of range and an unknown column change nothing.
    """
    names = {name: name.lower() for name, *_ in COLUMNS}
    last = rows.groupBy("table_id").agg(F.max("idx").alias("last"))
    old = F.coalesce(*(F.when(F.col("col") == name, F.col(c).cast("string")) for name, c in names.items()))
    error = (
        F.when(F.col("last").isNull(), F.concat(F.lit("Table not found: "), "table_id")).when((F.col("idx") < 0) | (F.col("idx") > F.col("last")), F.concat(F.lit("Invalid row index: "), F.col("idx").cast("string")))
        .when(~F.col("col").isin(*names), F.concat(F.lit("Unknown column: '"), "col", F.lit("'")))
    )
    judged = asked.join(last, "table_id", "left").withColumn("error", error).drop("last")
    done = judged.join(rows, ["table_id", "idx"], "left").select("table_id", "idx", "col", F.col("error").isNull().alias("success"), "error", F.when(F.col("error").isNull(), old).alias("old_value"), F.when(F.col("error").isNull(), F.col("value")).alias("new_value"))
    new = done.where("success").groupBy("table_id", "idx").agg(*(F.max(F.when(F.col("col") == name, F.col("new_value"))).alias(f"new {c}") for name, c in names.items()))
    kept = [F.coalesce(F.col(f"new {c}").try_cast(rows.schema[c].dataType), F.col(c)).alias(c) for c in names.values()]
    return rows.join(new, ["table_id", "idx"], "left").select("table_id", "idx", *kept), done


@query(f"WITH {ROWS_SQL}, {CELL_SQL} SELECT a.table_id, a.idx, a.idx <= last AND col = 'Kind' AS success, CASE WHEN a.idx > last THEN 'Invalid row index: 9999' WHEN col <> 'Kind' THEN 'Unknown column: ''Colour''' END AS error, CASE WHEN a.idx <= last AND col = 'Kind' THEN r.kind END AS old_value, CASE WHEN a.idx <= last AND col = 'Kind' THEN 'any text' END AS new_value FROM asked a LEFT JOIN rows_ r ON a.table_id = r.table_id AND a.idx = r.idx")
def a2t_update_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell of each table set to a text: some rows are out of range, some columns unknown; the value is not validated."""
    rows = _rows(spark, sf_dir)
    digit = F.substring("table_id", 7, 1)
    asked = rows.select("table_id").distinct().select("table_id", F.when(digit == "1", 9999).otherwise(1).cast("long").alias("idx"), F.when(digit == "3", "Colour").otherwise("Kind").alias("col"), F.lit("any text").alias("value"))
    return cells_updated(rows, asked)[1].drop("col")


@query(f"WITH {ROWS_SQL} SELECT table_id, idx, name FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY idx DESC) AS k FROM rows_) r WHERE k <= 2")
def a2t_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("idx")))).where("k <= 2").select("table_id", "idx", "name")


PREVIEW_SQL = f"""WITH {ROWS_SQL}, few AS (SELECT table_id, string_agg('| ' || name || ' | ' || CAST(size AS VARCHAR) || ' | ' || kind || ' |', chr(10) ORDER BY idx) AS body FROM rows_ WHERE idx < 10 GROUP BY table_id), n AS (SELECT table_id, count(*) AS n FROM rows_ GROUP BY table_id),
shown AS (SELECT table_id, n, '### ' || table_id || chr(10) || chr(10) || '| Name | Size | Kind |' || chr(10) || '| --- | --- | --- |' || chr(10) || body || CASE WHEN n > 10 THEN chr(10) || chr(10) || '*(Showing 10 of ' || CAST(n AS VARCHAR) || ' rows)*' ELSE '' END AS preview FROM few JOIN n USING (table_id))"""


def preview(rows: DataFrame, limit: int = 10) -> DataFrame:
    """table_id, n, preview: a heading, the columns, the first ``limit`` rows; further ones are counted below. Missing is ``-``, null is None."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    line = F.concat(F.lit("| "), F.coalesce("name", F.lit("None")), F.lit(" | "), F.coalesce(F.col("size").cast("string"), F.lit("None")), F.lit(" | "), F.coalesce("kind", F.lit("None")), F.lit(" |"))
    few = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("idx") < limit, F.struct("idx", line.alias("line"))))), lambda x: x.line), "\n")
    g = rows.groupBy("table_id").agg(F.count("*").alias("n"), few.alias("body"))
    foot = F.when(F.col("n") > limit, F.concat(F.lit(f"\n\n*(Showing {limit} of "), F.col("n").cast("string"), F.lit(" rows)*"))).otherwise("")
    return g.select("table_id", "n", F.concat(F.lit("### "), "table_id", F.lit("\n\n| Name | Size | Kind |\n| --- | --- | --- |\n"), "body", foot).alias("preview"))


@query(f"{PREVIEW_SQL} SELECT table_id, preview FROM shown")
def a2t_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(_rows(spark, sf_dir)).select("table_id", "preview")


@query(f"{PREVIEW_SQL}, j AS (SELECT table_id, sum(length('{{\"Name\": \"' || name || '\", \"Size\": ' || CAST(size AS VARCHAR) || ', \"Kind\": \"' || kind || '\"}}')) AS chars FROM rows_ GROUP BY table_id) SELECT table_id, CAST((chars + 2 * n) // 4 + 12 // 4 AS BIGINT) AS content, length(preview) // 4 AS preview, CAST(((chars + 2 * n) // 4 + 12 // 4) // greatest(n, 1) AS BIGINT) AS per_row FROM shown JOIN j USING (table_id)")
def a2t_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the characters of the rows as JSON with ', ' and ': ', plus the column names'."""
    rows = _rows(spark, sf_dir)
    one = F.concat(F.lit('{"Name": '), json_string(F.col("name")), F.lit(', "Size": '), F.coalesce(F.col("size").cast("string"), F.lit("null")), F.lit(', "Kind": '), json_string(F.col("kind")), F.lit("}"))
    j = rows.groupBy("table_id").agg(F.sum(F.length(one)).alias("chars"))
    content = F.floor((F.col("chars") + 2 * F.col("n")) / 4) + sum(len(c[0]) for c in COLUMNS) // 4
    return preview(rows).join(j, "table_id").select("table_id", content.alias("content"), F.floor(F.length("preview") / 4).alias("preview"), F.floor(content / F.greatest("n", F.lit(1))).alias("per_row"))


@query(f"WITH {ROWS_SQL} SELECT table_id, least(greatest(max(length(name)), 4) + 2, 50) AS name_width, least(greatest(max(length(CAST(size AS VARCHAR))), 4) + 2, 50) AS size_width FROM rows_ GROUP BY table_id")
def a2t_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column widths for a sheet: the longest value or the name, and two more, 50 at most; a null counts as four."""
    wide = lambda c, name: F.least(F.greatest(F.max(F.coalesce(F.length(F.col(c).cast("string")), F.lit(4))), F.lit(len(name))) + 2, F.lit(50)).cast("long")
    return _rows(spark, sf_dir).groupBy("table_id").agg(wide("name", "Name").alias("name_width"), wide("size", "Size").alias("size_width"))


STYLE_SQL = "graded AS (SELECT *, CASE WHEN size > 40 THEN 'High' WHEN size < 10 THEN 'low' ELSE 'medium' END AS confidence, table_id LIKE '%2%' AS comparison FROM rows_)"


@query(f"WITH {ROWS_SQL}, {STYLE_SQL} SELECT table_id, 'A' || CAST(idx + 4 AS VARCHAR) AS cell, name AS value, 'body' AS style FROM graded UNION ALL SELECT table_id, 'B' || CAST(idx + 4 AS VARCHAR), confidence, CASE WHEN comparison AND lower(confidence) = 'high' THEN 'high' WHEN comparison AND lower(confidence) = 'low' THEN 'low' ELSE 'body' END FROM graded")
def a2t_style_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and styles of the sheets of (Name, Confidence): the header takes row 3; only comparisons colour a column named confidence, high and low in any case."""
    rows = _rows(spark, sf_dir).withColumn("confidence", F.when(F.col("size") > 40, "High").when(F.col("size") < 10, "low").otherwise("medium"))
    grade = F.lower("confidence")
    style = F.when(F.col("table_id").contains("2") & grade.isin("high", "low"), grade).otherwise("body")
    cell = lambda column, value, how: rows.select("table_id", F.concat(F.lit(column), (F.col("idx") + 4).cast("string")).alias("cell"), F.col(value).alias("value"), how.alias("style"))
    return cell("A", "name", F.lit("body")).unionByName(cell("B", "confidence", style))


@query(f"WITH {ROWS_SQL} SELECT table_id, count(*) AS n_rows, 3 AS n_columns FROM rows_ GROUP BY table_id")
def a2t_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).groupBy("table_id").agg(F.count("*").alias("n_rows"), F.lit(3).alias("n_columns"))


DRAFT_SQL = """ops AS (SELECT user_id AS draft_id, event_id AS op, ts, CASE WHEN event_type = 'view' THEN 'title ' || CAST(event_id AS VARCHAR) END AS title, CASE WHEN event_type = 'click' THEN 'note ' || CAST(event_id AS VARCHAR) END AS notes,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN '[{"name": "Name", "type": "text"}]' END AS columns, CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'comparison' ELSE 'summary' END END AS intent,
  CASE WHEN event_type = 'purchase' THEN '{"' || CASE WHEN event_id % 4 = 0 THEN 'Nome' ELSE 'Name' END || '": "' || CAST(event_id AS VARCHAR) || '"}' END AS row FROM events),
drafts AS (SELECT draft_id, coalesce(max_by(title, op) FILTER (title IS NOT NULL), '') AS title, coalesce(max_by(notes, op) FILTER (notes IS NOT NULL), '') AS notes, coalesce(max_by(columns, op) FILTER (columns IS NOT NULL), '[]') AS columns, max_by(intent, op) FILTER (intent IS NOT NULL) AS intent,
  '[' || coalesce(string_agg(row, ', ' ORDER BY op) FILTER (row IS NOT NULL), '') || ']' AS rows, count(row) AS pending, count(*) FILTER (row LIKE '{"Name%') AS good, max(ts) AS updated_at FROM ops GROUP BY draft_id),
sized AS (SELECT *, length('{"title": "' || title || '", "columns": ' || columns || ', "plan": [], "pending": ' || rows || ', "notes": "' || notes || '"}') // 4 AS tokens FROM drafts)"""


def drafts(ops: DataFrame) -> DataFrame:
    """draft_id, title, notes, columns, intent, rows, pending, good, updated_at: each field's latest value that was set, and all rows in order.

    An operation sets some fields and leaves the others null; ``columns`` and ``row`` are JSON with ', ' and ': '. ``good`` counts the rows that name the draft's one column.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("op")))
    rows = F.transform(F.array_sort(F.collect_list(F.when(F.col("row").isNotNull(), F.struct("op", "row")))), lambda x: x.row)
    good = F.count_if(F.array_contains(F.json_object_keys("row"), "Name"))
    return ops.groupBy("draft_id").agg(
        F.coalesce(last("title"), F.lit("")).alias("title"), F.coalesce(last("notes"), F.lit("")).alias("notes"), F.coalesce(last("columns"), F.lit("[]")).alias("columns"), last("intent").alias("intent"),
        F.concat(F.lit("["), F.array_join(rows, ", "), F.lit("]")).alias("rows"), F.count("row").alias("pending"), good.alias("good"), F.max("ts").alias("updated_at"),
    )


def draft_size(title: Column, columns: Column, plan: Column, rows: Column, notes: Column) -> Column:
    """A quarter of the characters of a draft's JSON; columns, plan and rows are JSON already."""
    return F.floor(F.length(F.concat(F.lit('{"title": '), json_string(title), F.lit(', "columns": '), columns, F.lit(', "plan": '), plan, F.lit(', "pending": '), rows, F.lit(', "notes": '), json_string(notes), F.lit("}"))) / 4)


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind, k = read(spark, sf_dir, "events"), F.col("event_type"), F.col("event_id")
    word = lambda event, text: F.when(kind == event, F.concat(F.lit(text + " "), k.cast("string")))
    row = F.concat(F.lit('{"'), F.when(k % 4 == 0, "Nome").otherwise("Name"), F.lit('": "'), k.cast("string"), F.lit('"}'))
    return drafts(e.select(
        F.col("user_id").alias("draft_id"), k.alias("op"), "ts", word("view", "title").alias("title"), word("click", "note").alias("notes"), F.when((kind == "error") & (k % 3 == 0), '[{"name": "Name", "type": "text"}]').alias("columns"),
        F.when(kind == "signup", F.when(k % 2 == 0, "comparison").otherwise("summary")).alias("intent"), F.when(kind == "purchase", row).alias("row"),
    ))


@query(f"WITH {DRAFT_SQL} SELECT draft_id, title, notes, columns, intent, updated_at FROM drafts")
def drafts_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drafts(spark, sf_dir).select("draft_id", "title", "notes", "columns", "intent", "updated_at")


@query(f"WITH {DRAFT_SQL} SELECT draft_id, title, intent, CASE WHEN columns = '[]' THEN 0 ELSE 1 END AS columns_planned, pending FROM drafts")
def drafts_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drafts(spark, sf_dir).select("draft_id", "title", "intent", F.json_array_length("columns").alias("columns_planned"), "pending")


@query(f"WITH {DRAFT_SQL} SELECT draft_id, tokens FROM sized")
def draft_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drafts(spark, sf_dir).select("draft_id", draft_size(F.col("title"), F.col("columns"), F.lit("[]"), F.col("rows"), F.col("notes")).alias("tokens"))


@query(f"WITH {DRAFT_SQL} SELECT draft_id, columns <> '[]' AND intent IS NOT NULL AS success, CASE WHEN columns = '[]' THEN 'Draft has no columns defined' WHEN intent IS NULL THEN 'Draft has no intent defined' END AS error, CASE WHEN columns <> '[]' AND intent IS NOT NULL THEN good END AS added, CASE WHEN columns <> '[]' AND intent IS NOT NULL THEN pending - good END AS rejected FROM drafts")
def draft_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which drafts become tables, and how many of their rows pass; a draft needs columns and an intent, no title or rows."""
    error = F.when(F.json_array_length("columns") == 0, "Draft has no columns defined").when(F.col("intent").isNull(), "Draft has no intent defined")
    made = lambda c: F.when(error.isNull(), c)
    return _drafts(spark, sf_dir).select("draft_id", error.isNull().alias("success"), error.alias("error"), made(F.col("good")).alias("added"), made(F.col("pending") - F.col("good")).alias("rejected"))


def workbook(rows: DataFrame, table_id: str, source: str = "", comparison: bool = False, most: int = 1_048_573) -> bytes:
    """One table's sheet. A sheet holds 1,048,576 rows with title, source and header; a table of more is refused, none is cut. Rows come partition by partition."""
    own = rows.where(F.col("table_id") == table_id)
    if own.limit(most + 1).count() > most:
        raise ValueError(f"table {table_id} has more than {most} rows")
    kinds = {name: kind for name, kind, *_ in COLUMNS}
    values = own.orderBy("idx").select(*(F.col(c.lower()).alias(c) for c in kinds))
    return xlsx((r.asDict() for r in values.toLocalIterator()), list(kinds), table_id, source, comparison, kinds)
