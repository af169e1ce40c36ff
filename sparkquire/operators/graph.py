"""The entity graph: extraction, nodes and edges, retrieval, exports."""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query, read
from .chunking import basic

#: Words that name nothing by themselves.
STOP = ("The", "This", "These", "What")
#: White space and word characters of any script, as Python's re has them; Java looks behind by whole characters where the pattern holds one beyond 16 bits.
SPACE, LETTER = r"[\s\x{85}\x1c-\x1f\p{Z}]", "[\\p{L}\\p{N}_\U0001d400]"
RUN = rf"((?<!{LETTER})[A-Z][a-z]+(?:{SPACE}+[A-Z][a-z]+)*(?!{LETTER}))"


def entities(text: Column) -> Column:
    """Quoted strings, then runs of capitalised words, in order, without the stop-list; of equal ones in any case the first."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))
    caps = F.filter(F.regexp_extract_all(text, F.lit(RUN), F.lit(1)), lambda x: ~x.isin(*STOP))
    return F.concat(quoted, caps)


NODES_SQL = """nodes AS (
  SELECT n_name AS id, 'nation' AS type, 'nation of region ' || CAST(n_regionkey AS VARCHAR) AS description, n_nationkey + 100 AS ordinal FROM nation
  UNION ALL SELECT r_name, 'region', 'region', r_regionkey FROM region
  UNION ALL SELECT s_name, 'supplier', repeat('supplies goods; ', 20), 1000 + s_suppkey FROM supplier),
edges AS (SELECT n.n_name AS source, r.r_name AS target, 'lies in' AS keywords, '1.0' AS weight FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL SELECT s.s_name, n.n_name, CASE WHEN s.s_suppkey % 2 = 0 THEN 'based in' ELSE '' END, CAST(s.s_suppkey % 5 AS VARCHAR) || '.5' FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey),
kept AS (SELECT * FROM nodes WHERE type IN ('nation', 'region') ORDER BY ordinal LIMIT 20),
inner_edges AS (SELECT * FROM edges WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept))"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, s = (read(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    row = lambda df, name, kind, text, key: df.select(F.col(name).alias("id"), F.lit(kind).alias("type"), text.alias("description"), key.cast("long").alias("ordinal"))
    return row(n, "n_name", "nation", F.concat(F.lit("nation of region "), F.col("n_regionkey").cast("string")), F.col("n_nationkey") + 100).unionByName(row(r, "r_name", "region", F.lit("region"), F.col("r_regionkey"))).unionByName(row(s, "s_name", "supplier", F.lit("supplies goods; " * 20), F.col("s_suppkey") + 1000))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, s = (read(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    a = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("lies in").alias("keywords"), F.lit("1.0").alias("weight"))
    words, weight = F.when(F.col("s_suppkey") % 2 == 0, "based in").otherwise(""), F.concat((F.col("s_suppkey") % 5).cast("string"), F.lit(".5"))
    return a.unionByName(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("source"), F.col("n_name").alias("target"), words.alias("keywords"), weight.alias("weight")))


def kept_nodes(all_nodes: DataFrame, types: list[str] | None, limit: int) -> DataFrame:
    """The first ``limit`` nodes of those types, by their place in the file."""
    some = all_nodes.where(F.col("type").isin(*types)) if types else all_nodes
    return some.orderBy("ordinal").limit(limit)


def inner_edges(all_edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among the kept nodes."""
    return all_edges.join(kept.select(F.col("id").alias("source")), "source", "left_semi").join(kept.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "keywords", "weight")


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_nodes(nodes(spark, sf_dir), ["nation", "region"], 20)


@query(f"WITH {NODES_SQL} SELECT id, type FROM nodes WHERE type IN ('region', 'supplier')")
def kg_nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where(F.col("type").isin("region", "supplier")).select("id", "type")


@query(f"WITH {NODES_SQL} SELECT * FROM inner_edges")
def kg_edges_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_edges(edges(spark, sf_dir), _kept(spark, sf_dir))


@query(f"WITH {NODES_SQL} SELECT type, count(*) AS n, (SELECT count(*) FROM kept) AS total_nodes, (SELECT count(*) FROM inner_edges) AS total_edges FROM kept GROUP BY type")
def kg_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what is kept: after the type filter, the limit and the edges' semi-joins."""
    kept = _kept(spark, sf_dir)
    totals = kept.agg(F.count("*").alias("total_nodes")).crossJoin(inner_edges(edges(spark, sf_dir), kept).agg(F.count("*").alias("total_edges")))
    return kept.groupBy("type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(totals))


@query(f"WITH {NODES_SQL} SELECT id, type, CASE WHEN length(description) > 200 THEN substring(description, 1, 200) || '...' ELSE description END AS description FROM nodes ORDER BY ordinal LIMIT 50")
def kg_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("description")
    return kept_nodes(nodes(spark, sf_dir), None, 50).select("id", "type", F.when(F.length(d) > 200, F.concat(F.substring(d, 1, 200), F.lit("..."))).otherwise(d).alias("description"))


@query(
    f"WITH {NODES_SQL}, named AS (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS k FROM kept), es AS (SELECT a.k AS s, b.k AS t, keywords FROM inner_edges e JOIN named a ON e.source = a.id JOIN named b ON e.target = b.id) "
    "SELECT 0 AS part, k AS place, '    N' || CAST(k AS VARCHAR) || '[\"' || substring(id, 1, 25) || '\"]' AS line FROM named UNION ALL SELECT 1, s * 1000 + t, '    N' || CAST(s AS VARCHAR) || CASE WHEN keywords = '' THEN ' --> ' ELSE ' -->|' || substring(keywords, 1, 15) || '| ' END || 'N' || CAST(t AS VARCHAR) FROM es"
)
def kg_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a flow chart: nodes N0.. with their labels, then edges with their keywords."""
    named = _kept(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ordinal")) - 1).select("id", F.col("k").cast("long").alias("k"))
    e = inner_edges(edges(spark, sf_dir), named).join(named.select(F.col("id").alias("source"), F.col("k").alias("s")), "source").join(named.select(F.col("id").alias("target"), F.col("k").alias("t")), "target")
    n = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    arrow = F.when(F.col("keywords") == "", " --> ").otherwise(F.concat(F.lit(" -->|"), F.substring("keywords", 1, 15), F.lit("| ")))
    first = named.select(F.lit(0).alias("part"), F.col("k").alias("place"), F.concat(F.lit("    "), n("k"), F.lit('["'), F.substring("id", 1, 25), F.lit('"]')).alias("line"))
    return first.unionByName(e.select(F.lit(1).alias("part"), (F.col("s") * 1000 + F.col("t")).alias("place"), F.concat(F.lit("    "), n("s"), arrow, n("t")).alias("line")))


def first_entities(docs: DataFrame, limit: int = 5) -> DataFrame:
    """doc_id, place, entity: the first ``limit`` distinct ones of each document; each row sends no more than these."""
    lowered = lambda xs: F.transform(F.array(F.transform(xs, F.lower)), lambda low: F.transform(F.slice(F.array_distinct(low), 1, limit), lambda x: F.struct(F.array_position(low, x).alias("at"), F.get(xs, F.array_position(low, x) - 1).alias("entity"))))
    each = docs.select("doc_id", F.explode(F.flatten(F.flatten(F.transform(F.array(entities(F.col("text"))), lowered)))).alias("e")).select("doc_id", "e.*")
    first = each.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", F.lower("entity")).orderBy("at"))).where("k = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).cast("long")).where(F.col("place") <= limit).select("doc_id", "place", "entity")


CHUNK_CHARS, PAIRS = 3200, 1 << 21


def cooccurrences(docs: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """source, target, weight: the number of chunks (800 tokens of four characters, cut by `basic` without overlap) in which both entities begin.

    Entities are those of `entities` over the whole text, so a chunk's end cuts none; in a
    chunk the first of those equal in any case stands for them. Pairs are counted in each task before they are shuffled.
    """
    at = docs.where("text is not null").select("text", F.transform(basic(F.col("text"), size, 0, 0), lambda x: x["start"]).alias("starts"))
    return at.mapInArrow(_pairs, "source string, target string, n long").groupBy("source", "target").agg(F.sum("n").alias("weight"))


_QUOTED, _RUN = re.compile(r'"([^"]+)"'), re.compile(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b")


def chunk_entities(text: str, starts: list[int]) -> list[list[str]]:
    """The distinct entities that begin in each chunk: quoted strings, then runs."""
    found: list[dict[str, str]] = [{} for _ in starts]
    for pattern, group in ((_QUOTED, 1), (_RUN, 0)):
        for m in pattern.finditer(text):
            if group or m[0] not in STOP:
                found[bisect_right(starts, m.start()) - 1].setdefault(m[group].lower(), m[group])
    return [list(x.values()) for x in found]


def _pairs(batches):
    codes: dict[str, int] = {}
    held, total = [], 0

    def counted():
        names = pa.array(list(codes), pa.string())
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        for k in range(0, len(pairs), 1 << 16):
            p = pairs[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(p >> 32)), names.take(pa.array(p & 0xFFFFFFFF)), pa.array(n[k : k + (1 << 16)])], ["source", "target", "n"])

    for batch in batches:
        for text, starts in zip(batch.column("text"), batch.column("starts")):
            for some in chunk_entities(text.as_py(), starts.as_py()):
                if len(some) > 1:
                    own = np.array([codes.setdefault(e, len(codes)) for e in sorted(some)], np.int64)
                    a, b = np.triu_indices(len(own), 1)
                    held.append(own[a] << 32 | own[b])
                    total += len(a)
                if total >= PAIRS:
                    yield from counted()
                    codes.clear()
                    held, total = [], 0
    if held:
        yield from counted()


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole text after a phrase with a quoted name."""
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('"Drug '), (F.col("doc_id") % 50).cast("string"), F.lit('" and The Best Of '), F.col("text")).alias("text"))


@query()
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_entities(_docs(spark, sf_dir))


@query()
def kg_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between entities that occur together in more than one chunk, over all chunks of the whole texts."""
    return cooccurrences(_docs(spark, sf_dir)).where("weight > 1")


LOCAL_SQL = f"WITH {NODES_SQL}, hit AS (SELECT id, ordinal FROM nodes WHERE contains(lower(id), 'a') ORDER BY ordinal LIMIT 5), around AS (SELECT 'local' AS mode, source, target, weight FROM edges WHERE source IN (SELECT id FROM hit) OR target IN (SELECT id FROM hit)), wide AS (SELECT 'global' AS mode, source, target, weight FROM edges WHERE contains(keywords, 'based') ORDER BY CAST(weight AS DOUBLE) DESC, source, target LIMIT 10)"


def local_edges(n: DataFrame, e: DataFrame, term: str, k: int = 5) -> DataFrame:
    """Edges at the first ``k`` nodes whose name holds the term."""
    hit = n.where(F.lower("id").contains(term.lower())).orderBy("ordinal").limit(k).select("id")
    at = e.join(hit, F.col("source") == F.col("id"), "left_semi").unionByName(e.join(hit, F.col("target") == F.col("id"), "left_semi").join(hit, F.col("source") == F.col("id"), "left_anti"))
    return at.select(F.lit("local").alias("mode"), "source", "target", "weight")


def global_edges(e: DataFrame, word: str, k: int = 10) -> DataFrame:
    """The ``k`` heaviest edges with the word among their keywords."""
    return e.where(F.col("keywords").contains(word)).orderBy(F.col("weight").cast("double").desc(), "source", "target").limit(k).select(F.lit("global").alias("mode"), "source", "target", "weight")


@query(f"{LOCAL_SQL} SELECT * FROM around")
def kg_query_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_edges(nodes(spark, sf_dir), edges(spark, sf_dir), "A")


@query(f"{LOCAL_SQL} SELECT * FROM wide")
def kg_query_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_edges(edges(spark, sf_dir), "based")


@query(f"{LOCAL_SQL} SELECT DISTINCT source, target, weight FROM (SELECT * FROM around UNION ALL SELECT * FROM wide) u")
def kg_query_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg_query_local(spark, sf_dir).unionByName(kg_query_global(spark, sf_dir)).select("source", "target", "weight").distinct()


def nearest(vectors: DataFrame, wanted: DataFrame, k: int = 5, block: int = 1000) -> DataFrame:
    """query_id, vec_id, cosine, place: the ``k`` rows of ``vectors`` nearest to each of ``wanted`` (vec_id, embedding), itself left out.

    Brute force: the queries go out in blocks of ``block``, each task keeps its
    best ``k`` of a query, and only those are shuffled. Ties: the smaller vec_id.
    """
    wanted = wanted.where("vec_id is not null and embedding is not null")
    blocks = max(1, -(-wanted.count() // block))
    out = None
    for n in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).toPandas()
        part = vectors.where("vec_id is not null and embedding is not null").select("vec_id", "embedding").mapInPandas(_best(rows, k), "query_id long, vec_id long, cosine double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return out.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def _best(rows: pd.DataFrame, k: int):
    def unit(x):
        m = np.stack([np.asarray(v, float) for v in x])
        size = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def run(batches):
        ids = rows.vec_id.to_numpy()
        for batch in batches if len(rows) else ():
            if not len(batch):
                continue
            mine = batch.vec_id.to_numpy()
            cosine = unit(rows.embedding) @ unit(batch.embedding).T
            cosine[ids[:, None] == mine] = -np.inf
            by = np.argsort(mine, kind="stable")
            top = by[np.argsort(-cosine[:, by], axis=1, kind="stable")[:, :k]]
            best = np.take_along_axis(cosine, top, 1)
            use = np.isfinite(best)
            yield pd.DataFrame({"query_id": np.broadcast_to(ids[:, None], best.shape)[use], "vec_id": mine[top][use], "cosine": best[use]})

    return run


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)) AS cosine FROM q JOIN v ON q.vec_id <> v.vec_id) SELECT query_id, vec_id, CAST(k AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS k FROM s) r WHERE k <= 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest to each whose id is divisible by 50, over all rows."""
    v = read(spark, sf_dir, "embeddings")
    return nearest(v, v.where("vec_id % 50 = 0").select("vec_id", "embedding")).select("query_id", "vec_id", "place")
