"""Page geometry: clusters of drawings, coverage of grid cells, headings from font sizes, visual content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query, read

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"


def clusters(rects: Column, near: float = 50, least: float = 80) -> Column:
    """Bounding boxes of runs of rectangles, from top to bottom: one joins while its distance below or right of the box is under ``near``; boxes wider and higher than ``least`` stay."""
    r = F.array_sort(F.filter(rects, lambda x: (x["x1"] - x["x0"] > 1) | (x["y1"] - x["y0"] > 1)), lambda a, b: F.when(a["y0"] < b["y0"], -1).when(a["y0"] > b["y0"], 1).otherwise(0))
    large = lambda x: (x["x1"] - x["x0"] > least) & (x["y1"] - x["y0"] > least)
    push = lambda a: F.when(large(a["cur"]), F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"])

    def step(a, x):
        c = a["cur"]
        far = F.greatest(F.lit(0.0), x["y0"] - c["y1"], x["x0"] - c["x1"])
        both = F.struct(F.least(c["x0"], x["x0"]).alias("x0"), F.least(c["y0"], x["y0"]).alias("y0"), F.greatest(c["x1"], x["x1"]).alias("x1"), F.greatest(c["y1"], x["y1"]).alias("y1"))
        return F.when(c.isNull() | (far < near), F.struct(F.when(c.isNull(), x).otherwise(both).alias("cur"), a["out"].alias("out"))).otherwise(F.struct(x.alias("cur"), push(a).alias("out")))

    zero = F.struct(F.lit(None).cast(RECT).alias("cur"), F.array().cast(f"array<{RECT}>").alias("out"))
    return F.aggregate(r, zero, step, push)


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = (k * 37 % 600).cast("double"), (k * 91 % 800).cast("double")
    return read(spark, sf_dir, "part").select((k % 40).alias("page"), k, x.alias("x0"), y.alias("y0"), (x + k % 90).alias("x1"), (y + k % 70).alias("y1"))


CLUSTERS_SQL = """WITH RECURSIVE rects AS (SELECT p_partkey % 40 AS page, CAST(p_partkey * 37 % 600 AS DOUBLE) AS x0, CAST(p_partkey * 91 % 800 AS DOUBLE) AS y0, CAST(p_partkey * 37 % 600 + p_partkey % 90 AS DOUBLE) AS x1, CAST(p_partkey * 91 % 800 + p_partkey % 70 AS DOUBLE) AS y1 FROM part),
placed AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, x1, y1) AS k FROM rects WHERE x1 - x0 > 1 OR y1 - y0 > 1),
walk AS (SELECT page, k, x0, y0, x1, y1, false AS new, x0 AS ox0, y0 AS oy0, x1 AS ox1, y1 AS oy1 FROM placed WHERE k = 1
  UNION ALL SELECT w.page, w.k + 1, CASE WHEN far THEN w.nx0 ELSE least(w.x0, w.nx0) END, CASE WHEN far THEN w.ny0 ELSE least(w.y0, w.ny0) END, CASE WHEN far THEN w.nx1 ELSE greatest(w.x1, w.nx1) END, CASE WHEN far THEN w.ny1 ELSE greatest(w.y1, w.ny1) END, far, w.x0, w.y0, w.x1, w.y1
  FROM (SELECT v.page, v.k, v.x0, v.y0, v.x1, v.y1, p.x0 AS nx0, p.y0 AS ny0, p.x1 AS nx1, p.y1 AS ny1, greatest(0.0, p.y0 - v.y1, p.x0 - v.x1) >= 50 AS far FROM walk v JOIN placed p ON v.page = p.page AND p.k = v.k + 1) w),
boxes AS (SELECT page, ox0 AS x0, oy0 AS y0, ox1 AS x1, oy1 AS y1 FROM walk WHERE new UNION ALL SELECT w.page, w.x0, w.y0, w.x1, w.y1 FROM walk w JOIN (SELECT page, max(k) AS k FROM placed GROUP BY page) e ON w.page = e.page AND w.k = e.k)
SELECT * FROM boxes WHERE x1 - x0 > 80 AND y1 - y0 > 80"""


@query(CLUSTERS_SQL)
def cluster_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _rects(spark, sf_dir).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("x0", "y0", "x1", "y1"))).alias("rects"))
    return g.select("page", F.explode(clusters(F.col("rects"))).alias("c")).select("page", "c.*")


@query(
    "WITH rects AS (SELECT p_partkey % 40 AS page, CAST(p_partkey * 37 % 600 AS DOUBLE) AS x0, CAST(p_partkey * 91 % 800 AS DOUBLE) AS y0, p_partkey * 37 % 600 + p_partkey % 90 AS x1, p_partkey * 91 % 800 + p_partkey % 70 AS y1 FROM part), cells AS (SELECT a.i AS col, b.i AS row FROM range(4) a(i), range(4) b(i)), "
    "o AS (SELECT page, col, row, greatest(0, least(x1, (col + 1) * 150) - greatest(x0, col * 150)) * greatest(0, least(y1, (row + 1) * 200) - greatest(y0, row * 200)) AS area FROM rects, cells) SELECT page, col, row, CAST(sum(area) AS DOUBLE) AS area FROM o WHERE area > 0 GROUP BY ALL"
)
def grid_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area that rectangles cover in each cell of a 4 x 4 grid: each rectangle is sent to the cells it touches only."""
    r = _rects(spark, sf_dir)
    cells = lambda a, b, n: F.sequence(F.greatest(F.floor(F.col(a) / n), F.lit(0)), F.least(F.floor(F.col(b) / n), F.lit(3)))
    at = r.where("x0 < 600 and y0 < 800").withColumn("col", F.explode(cells("x0", "x1", 150))).withColumn("row", F.explode(cells("y0", "y1", 200)))
    side = lambda a, b, c, n: F.greatest(F.lit(0.0), F.least(F.col(b), (F.col(c) + 1) * n) - F.greatest(F.col(a), F.col(c) * n))
    o = at.withColumn("area", side("x0", "x1", "col", 150) * side("y0", "y1", "row", 200)).where("area > 0")
    return o.groupBy("page", "col", "row").agg(F.sum("area").alias("area"))


def span_text(size: Column, bold: Column, text: Column) -> Column:
    """A span's markdown: headings by font size, bold unless a heading mark stands first; blank spans are null."""
    mark = F.when(size > 16, "# ").when(size > 14, "## ").when(size > 12, "### ").otherwise("")
    line = F.concat(mark, text)
    return F.when(F.trim(text) != "", F.when((bold.bitwiseAND(16) != 0) & ~line.startswith("#"), F.concat(F.lit("**"), line, F.lit("**"))).otherwise(line))


@query("SELECT p_partkey, CASE WHEN p_size > 16 THEN '# ' || p_name WHEN p_size > 14 THEN '## ' || p_name WHEN p_size > 12 THEN '### ' || p_name WHEN (p_partkey & 16) <> 0 THEN '**' || p_name || '**' ELSE p_name END AS line FROM part")
def span_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", span_text(F.col("p_size"), F.col("p_partkey"), F.col("p_name")).alias("line"))


def visual(text: Column) -> Column:
    """Whether the first 1000 bytes of a text in UTF-8 have a variance over 100, in whole numbers; null and under 100 bytes never."""
    n, h = F.least(F.coalesce(F.octet_length(text), F.lit(0)), F.lit(1000)), F.hex(F.encode(text, "UTF-8"))
    v = F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substring(h, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    add = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when(n >= 100, n * add(F.transform(v, lambda b: b * b)) - add(v) * add(v) > 100 * n * n).otherwise(False)


@query(
    "WITH h AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark), b AS (SELECT item_id, length(h) // 2 AS n, unnest(list_transform(range(0, least(length(h) // 2, 1000)), lambda i: CAST('0x' || substring(h, CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER))) AS v FROM h) "
    "SELECT i.item_id, coalesce(x.n >= 100 AND x.v > 100, false) AS visual FROM benchmark i LEFT JOIN (SELECT item_id, n, var_pop(v) AS v FROM b GROUP BY item_id, n) x ON i.item_id = x.item_id"
)
def visual_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first 1000 bytes of each item vary by more than 100 in variance; under 100 bytes never."""
    return read(spark, sf_dir, "benchmark").select("item_id", visual(F.col("text")).alias("visual"))
