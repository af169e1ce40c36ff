"""User-declared tables and drafts as a store: every change gives a new store, and is refused with a ValueError or a result that says why.

A store is four DataFrames: tables (a row each, with its columns), rows (table_id, idx, row VARIANT), drafts and draft_rows. Commands
look at single tables and drafts, whose descriptions are one row; rows stay DataFrames, whatever their number.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pytext import json_string
from ..plans.registry import query, read
from ..sources.sheet import xlsx
from .records import draft_size, errors

COLUMN = "struct<name: string, type: string, required: boolean, enum_values: array<string>>"
TABLES = f"table_id string, intent string, title string, columns array<{COLUMN}>, source_description string, created_at timestamp_ntz"
ROWS = "table_id string, idx long, row variant"
DRAFTS = f"draft_id string, table_id string, intent string, title string, proposed_columns array<{COLUMN}>, extraction_plan array<string>, source_doc_ids array<string>, source_sections array<string>, notes string, last_updated timestamp_ntz"
DRAFT_ROWS = "draft_id string, at long, row variant"
#: The fields of a draft that an update may set.
FIELDS = ("table_id", "intent", "title", "proposed_columns", "extraction_plan", "source_doc_ids", "source_sections", "pending_rows", "notes")
#: The rows of a saved preview.
SAVED = 1000


def columns_of(given: list[dict]) -> list[tuple]:
    """Column descriptions with their defaults: required unless said otherwise."""
    return [(c["name"], c["type"], c.get("required", True), list(c["enum_values"]) if c.get("enum_values") else None) for c in given]


def create_params(given: list[dict]) -> list[dict]:
    """A planned schema's columns as arguments of a new table; allowed values are not passed on."""
    return [{"name": c["name"], "type": c["type"], "required": c.get("required", True)} for c in given]


def shown(value: Column) -> Column:
    """A VARIANT cell as text: ``-`` where the key is missing, None for null, True and False."""
    plain = F.try_variant_get(value, "$", "string")
    kind = F.schema_of_variant(value)
    return F.when(value.isNull(), "-").when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(plain)).otherwise(plain)


def _variants(spark: SparkSession, rows: list[dict], schema: str, key: str) -> DataFrame:
    """Few given rows as VARIANT with their place."""
    made = spark.createDataFrame([(key, k, json.dumps(r, ensure_ascii=False)) for k, r in enumerate(rows)], schema.replace("variant", "string"))
    return made.withColumn("row", F.parse_json("row"))


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    tables: DataFrame
    rows: DataFrame
    drafts: DataFrame
    draft_rows: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Store:
        none = lambda schema: spark.createDataFrame([], schema)
        return Store(spark, none(TABLES), none(ROWS), none(DRAFTS), none(DRAFT_ROWS))

    # One description

    def table(self, table_id: str) -> Row:
        found = self.tables.where(F.col("table_id") == table_id).take(1)
        if not found:
            raise ValueError(f"Table not found: {table_id}")
        return found[0]

    def draft(self, draft_id: str) -> Row:
        found = self.drafts.where(F.col("draft_id") == draft_id).take(1)
        if not found:
            raise ValueError(f"Draft not found: {draft_id}")
        return found[0]

    def own(self, table_id: str) -> DataFrame:
        return self.rows.where(F.col("table_id") == table_id)

    def size(self, table_id: str) -> int:
        return self.own(table_id).count()

    def _checks(self, table: Row) -> tuple:
        return tuple((c.name, c.type, c.required, tuple(c.enum_values or ())) for c in table.columns)

    def _at(self, table_id: str, idx: int) -> Row:
        table = self.table(table_id)
        if not 0 <= idx < self.size(table_id):
            raise ValueError(f"Invalid row index: {idx}")
        return table

    # Tables

    def create(self, intent: str, title: str, columns: list[dict], source_description: str = "", table_id: str | None = None) -> tuple[Store, str]:
        table_id = table_id or f"tbl_{uuid.uuid4().hex[:8]}"
        one = self.spark.createDataFrame([(table_id, intent, title, columns_of(columns), source_description, datetime.now())], TABLES)
        return replace(self, tables=self.tables.unionByName(one)), table_id

    def judged(self, table_id: str, rows: DataFrame) -> DataFrame:
        """``rows`` (at, row) and errors: all messages of each, an empty array where it is good."""
        return rows.withColumn("errors", errors(F.col("row"), self._checks(self.table(table_id))))

    def add(self, table_id: str, rows: DataFrame | list[dict]) -> tuple[Store, dict]:
        """Good rows follow the table's last in the order of ``at``; bad ones are reported with their place in the batch, as a DataFrame (row_index, errors)."""
        given = _variants(self.spark, rows, "k string, at long, row variant", "").drop("k") if isinstance(rows, list) else rows
        judged, before = self.judged(table_id, given), self.size(table_id)
        good = judged.where(F.size("errors") == 0)
        placed = good.select(F.lit(table_id).alias("table_id"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at")) - 1 + before).cast("long").alias("idx"), "row")
        n, bad = good.count(), judged.where(F.size("errors") > 0).select(F.col("at").alias("row_index"), "errors")
        after = replace(self, rows=self.rows.unionByName(placed)) if n else self
        return after, {"success": n > 0, "added": n, "total_rows": before + n, "errors": bad if bad.take(1) else None}

    def update_row(self, table_id: str, idx: int, row: dict) -> tuple[Store, dict]:
        self._at(table_id, idx)
        new = _variants(self.spark, [row], "k string, at long, row variant", "")
        found = self.judged(table_id, new).first()["errors"]
        if found:
            return self, {"success": False, "errors": found}
        here = (F.col("table_id") == table_id) & (F.col("idx") == idx)
        return replace(self, rows=self.rows.withColumn("row", F.when(here, F.parse_json(F.lit(json.dumps(row, ensure_ascii=False)))).otherwise(F.col("row")))), {"success": True}

    def delete_row(self, table_id: str, idx: int) -> tuple[Store, dict]:
        """The rows behind it move up."""
        self._at(table_id, idx)
        here = F.col("table_id") == table_id
        left = self.rows.where(~(here & (F.col("idx") == idx))).withColumn("idx", F.when(here & (F.col("idx") > idx), F.col("idx") - 1).otherwise(F.col("idx")))
        return replace(self, rows=left), {"success": True, "total_rows": self.size(table_id) - 1}

    def update_cell(self, table_id: str, idx: int, column: str, value) -> tuple[Store, dict]:
        """The place and the column are checked, the value is not."""
        table = self._at(table_id, idx)
        if column not in [c.name for c in table.columns]:
            raise ValueError(f"Unknown column: '{column}'")
        old = json.loads(self.own(table_id).where(F.col("idx") == idx).select(F.to_json("row")).first()[0])
        here = (F.col("table_id") == table_id) & (F.col("idx") == idx)
        new = json.dumps({**old, column: value}, ensure_ascii=False)
        after = replace(self, rows=self.rows.withColumn("row", F.when(here, F.parse_json(F.lit(new))).otherwise(F.col("row"))))
        return after, {"success": True, "row_index": idx, "column": column, "old_value": old.get(column), "new_value": value}

    def delete_table(self, table_id: str) -> tuple[Store, bool]:
        there = bool(self.tables.where(F.col("table_id") == table_id).take(1))
        other = F.col("table_id") != table_id
        return replace(self, tables=self.tables.where(other), rows=self.rows.where(other)), there

    def listed(self) -> DataFrame:
        """table_id, title, intent, n_rows, created_at of all tables."""
        n = self.rows.groupBy("table_id").agg(F.count("*").alias("n_rows"))
        return self.tables.join(n, "table_id", "left").select("table_id", "title", "intent", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "created_at")

    def status(self, table_id: str) -> dict:
        """What is needed to go on: names, number of rows, the last two."""
        t, n = self.table(table_id), self.size(table_id)
        last = [json.loads(r[0]) for r in self.own(table_id).where(F.col("idx") >= n - 2).orderBy("idx").select(F.to_json("row")).collect()]
        return {"id": t.table_id, "title": t.title, "intent": t.intent, "columns": [c.name for c in t.columns], "row_count": n, "source_description": t.source_description, "created_at": str(t.created_at), "last_rows": last}

    def preview(self, table_id: str, limit: int = 10) -> str:
        if limit < 0:
            raise ValueError("limit must not be negative")
        t, n = self.table(table_id), self.size(table_id)
        if not t.columns:
            return "Table has no columns defined."
        names = [c.name for c in t.columns]
        cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(shown(F.try_variant_get("row", f"$['{name}']", "variant")) for name in names)), F.lit(" |"))
        body = [r[0] for r in self.own(table_id).where(F.col("idx") < limit).orderBy("idx").select(cells).toLocalIterator()]
        foot = f"\n\n*(Showing {limit} of {n} rows)*" if n > limit else ""
        return f"### {t.title}\n\n| {' | '.join(names)} |\n| {' | '.join('---' for _ in names)} |\n" + "\n".join(body) + foot

    def tokens(self, table_id: str) -> dict[str, int]:
        """A quarter of the characters of the rows as JSON and of the names; of two previews; and of a row."""
        t = self.table(table_id)
        got = self.own(table_id).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(spaced(F.col("row")))), F.lit(0)).alias("chars")).first()
        content = (got.chars + 2 * max(got.n, 1)) // 4 + sum(len(c.name) for c in t.columns) // 4
        return {"content": content, "preview": len(self.preview(table_id)) // 4, "full_preview": len(self.preview(table_id, SAVED)) // 4, "per_row": content // max(got.n, 1)}

    def render(self, table_id: str, form: str = "excel") -> dict:
        """The whole table as markdown, or as the bytes of a workbook."""
        t, n = self.table(table_id), self.size(table_id)
        if not n:
            raise ValueError("Cannot render an empty table. Add rows first.")
        if form == "markdown":
            return {"success": True, "format": form, "content": self.preview(table_id, n), "row_count": n}
        if form != "excel":
            raise NotImplementedError(f"Format '{form}' is not yet supported.")
        kinds = {c.name: c.type for c in t.columns}
        rows = (json.loads(r[0]) for r in self.own(table_id).orderBy("idx").select(F.to_json("row")).toLocalIterator())
        return {"success": True, "format": form, "content": xlsx(rows, list(kinds), t.title, t.source_description, t.intent == "comparison", kinds), "row_count": n}

    # Drafts

    def create_draft(self, title: str, draft_id: str | None = None, **fields) -> tuple[Store, str]:
        draft_id = draft_id or f"draft_{uuid.uuid4().hex[:8]}"
        one = (draft_id, None, fields.get("intent"), title, columns_of(fields.get("proposed_columns") or []), fields.get("extraction_plan") or [], fields.get("source_doc_ids") or [], fields.get("source_sections") or [], fields.get("notes", ""), datetime.now())
        return replace(self, drafts=self.drafts.unionByName(self.spark.createDataFrame([one], DRAFTS))), draft_id

    def update_draft(self, draft_id: str, **updates) -> tuple[Store, dict]:
        """Fields that a draft has not are passed over; pending rows are given anew as a list."""
        was = self.draft(draft_id).asDict()
        new = {k: columns_of(v) if k == "proposed_columns" else v for k, v in updates.items() if k in FIELDS and k != "pending_rows"}
        one = self.spark.createDataFrame([tuple({**was, **new, "last_updated": datetime.now()}.values())], DRAFTS)
        other = F.col("draft_id") != draft_id
        after = replace(self, drafts=self.drafts.where(other).unionByName(one))
        if "pending_rows" in updates:
            after = replace(after, draft_rows=self.draft_rows.where(other).unionByName(_variants(self.spark, updates["pending_rows"], DRAFT_ROWS, draft_id)))
        return after, {"success": True, "draft_id": draft_id}

    def add_to_draft(self, draft_id: str, rows: list[dict]) -> tuple[Store, int]:
        """Rows wait unvalidated behind those there; how many wait now."""
        self.draft(draft_id)
        before = self.draft_rows.where(F.col("draft_id") == draft_id).count()
        more = _variants(self.spark, rows, DRAFT_ROWS, draft_id).withColumn("at", F.col("at") + before)
        return replace(self, draft_rows=self.draft_rows.unionByName(more)), before + len(rows)

    def listed_drafts(self) -> DataFrame:
        n = self.draft_rows.groupBy("draft_id").agg(F.count("*").alias("n"))
        return self.drafts.join(n, "draft_id", "left").select("draft_id", "title", "intent", F.col("table_id").isNotNull().alias("has_table"), F.size("proposed_columns").alias("columns_planned"), F.coalesce("n", F.lit(0)).alias("pending_rows"), "last_updated")

    def delete_draft(self, draft_id: str) -> tuple[Store, bool]:
        there = bool(self.drafts.where(F.col("draft_id") == draft_id).take(1))
        other = F.col("draft_id") != draft_id
        return replace(self, drafts=self.drafts.where(other), draft_rows=self.draft_rows.where(other)), there

    def commit_draft(self, draft_id: str) -> tuple[Store, str, dict | None]:
        """The store with a table made of the draft, its id, and the result of adding the waiting rows, which stay with the draft: a second commit makes a second table."""
        d = self.draft(draft_id)
        if not d.proposed_columns:
            raise ValueError("Draft has no columns defined")
        if not d.intent:
            raise ValueError("Draft has no intent defined")
        after, table_id = self.create(d.intent, d.title, [c.asDict() for c in d.proposed_columns], f"Sources: {', '.join(d.source_doc_ids)}" if d.source_doc_ids else "")
        waiting = self.draft_rows.where(F.col("draft_id") == draft_id).select("at", "row")
        after, result = after.add(table_id, waiting) if waiting.take(1) else (after, None)
        return after.update_draft(draft_id, table_id=table_id)[0], table_id, result

    def draft_tokens(self, draft_id: str) -> int:
        d = self.draft(draft_id)
        columns = json.dumps([{k: v for k, v in c.asDict().items() if v is not None} for c in d.proposed_columns], ensure_ascii=False)
        rows = self.draft_rows.where(F.col("draft_id") == draft_id)
        body = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", spaced(F.col("row")).alias("x")))), lambda r: r.x), ", "), F.lit("]"))
        return rows.agg(draft_size(F.lit(d.title), F.lit(columns), F.lit(json.dumps(d.extraction_plan, ensure_ascii=False)), body, F.lit(d.notes))).first()[0]

    # Files

    def save(self, path: str) -> None:
        """All tables and drafts as JSON, rows beside them, and a preview of each table's first rows as text."""
        for name in ("tables", "drafts"):
            getattr(self, name).write.mode("overwrite").json(f"{path}/{name}")
        self.rows.withColumn("row", F.to_json("row")).write.mode("overwrite").partitionBy("table_id").json(f"{path}/rows")
        self.draft_rows.withColumn("row", F.to_json("row")).write.mode("overwrite").partitionBy("draft_id").json(f"{path}/draft_rows")
        self.previews(SAVED).write.mode("overwrite").partitionBy("table_id").text(f"{path}/previews")

    def previews(self, limit: int) -> DataFrame:
        """table_id, preview of all tables, each row's cells taken by the table's own columns."""
        names = F.transform("columns", lambda c: c["name"])
        cells = F.from_json(F.to_json("row"), "map<string,string>")
        line = F.concat(F.lit("| "), F.array_join(F.transform(names, lambda n: F.coalesce(F.try_element_at("cells", n), F.lit("-"))), " | "), F.lit(" |"))
        few = self.rows.where(F.col("idx") < limit).withColumn("cells", cells).join(self.tables.select("table_id", "columns"), "table_id").groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("x")))), lambda r: r.x), "\n").alias("body"))
        bar = lambda xs: F.concat(F.lit("| "), F.array_join(xs, " | "), F.lit(" |"))
        return self.tables.join(few, "table_id", "left").select("table_id", F.concat(F.lit("### "), "title", F.lit("\n\n"), bar(names), F.lit("\n"), bar(F.transform(names, lambda n: F.lit("---"))), F.lit("\n"), F.coalesce("body", F.lit(""))).alias("preview"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Store:
        """What `save` wrote; a row that cannot be read is passed over. The moment of a draft's last change is not restored."""
        def rows(name: str, schema: str) -> DataFrame:
            text = spark.read.schema(schema.replace("variant", "string")).option("mode", "DROPMALFORMED").json(f"{path}/{name}")
            return text.withColumn("row", F.try_parse_json("row")).where("row is not null")

        described = lambda name, schema, key: spark.read.schema(schema).option("mode", "PERMISSIVE").json(f"{path}/{name}").where(f"{key} is not null")
        drafts = described("drafts", DRAFTS, "draft_id").withColumn("last_updated", F.lit(datetime.now()).cast("timestamp_ntz"))
        return Store(spark, described("tables", TABLES, "table_id"), rows("rows", ROWS), drafts, rows("draft_rows", DRAFT_ROWS))


def spaced(row: Column) -> Column:
    """A flat VARIANT row as JSON with ', ' and ': '."""
    items = F.map_entries(F.from_json(F.to_json(row), "map<string,string>"))
    plain = lambda kv: F.schema_of_variant(F.try_variant_get(row, "$", "variant")).isNotNull() & kv["value"].isNotNull()
    text = lambda kv: F.when(plain(kv) & kv["value"].rlike(r"^(-?\d+(\.\d+)?|true|false)$"), kv["value"]).otherwise(json_string(kv["value"]))
    return F.concat(F.lit("{"), F.array_join(F.transform(items, lambda kv: F.concat(json_string(kv["key"]), F.lit(": "), text(kv))), ", "), F.lit("}"))


BRANDS_SQL = """named AS (SELECT p_partkey AS at, p_brand AS table_id, p_name AS name, p_size AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS idx FROM part WHERE p_size >= 10),
changed AS (SELECT table_id, CASE WHEN idx > 2 THEN idx - 1 ELSE idx END AS idx, CASE WHEN idx = 0 THEN 'first' ELSE name END AS name, CASE WHEN idx = 1 THEN '7' ELSE CAST(size AS VARCHAR) END AS size FROM named WHERE idx <> 2)"""


@query(f"WITH {BRANDS_SQL} SELECT table_id, idx, name, size FROM changed WHERE table_id = 'Brand#2'")
def a2t_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made, filled with a batch of which small sizes are refused, a row replaced, a cell set, a row deleted; refused changes in between change nothing."""
    store, t = Store.empty(spark).create("comparison", "Parts", [{"name": "Name", "type": "text"}, {"name": "Size", "type": "number"}], table_id="Brand#2")
    size = F.when(F.col("p_size") < 10, F.lit('"small"')).otherwise(F.col("p_size").cast("string"))
    rows = read(spark, sf_dir, "part").where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("at"), F.parse_json(F.concat(F.lit('{"Name": '), json_string(F.col("p_name")), F.lit(', "Size": '), size, F.lit("}"))).alias("row"))
    store, _ = store.add(t, rows)
    first = F.try_variant_get("row", "$.Size", "int")
    store, _ = store.update_cell(t, 0, "Name", "first")
    store, _ = store.update_cell(t, 1, "Size", "7")
    store, _ = store.update_row(t, 1, {"Size": "refused"})
    store, _ = store.delete_row(t, 2)
    return store.rows.select("table_id", "idx", F.try_variant_get("row", "$.Name", "string").alias("name"), F.coalesce(first.cast("string"), F.try_variant_get("row", "$.Size", "string")).alias("size"))
