"""One query for each operator of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chosen_path import jaccard_groups
from .common import table
from .decontam import contaminated_pairs
from .embedding_dedup import near_vectors
from .html_crf import extracted
from .lbl_lm import lm_scores
from .packing import packed
from .quality_cnn import quality_scores
from .suffix_dedup import removed_spans
from .toxicity import toxicity_scores
from .url_rules import judged

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiles")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (op1_embedding_dedup, op2_html_extraction, op3_url_filter, op4_toxicity, op5_decontamination, op6_jaccard_join, op7_packing, op8_suffix_dedup, op9_quality, op10_lm_scoring)}


#: DuckDB SQL for the queries that SQL expresses: every vector with every other, sets of shingles by their shared members, and all 50-byte strings.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": """WITH RECURSIVE rows_ AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT * FROM rows_ WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM rows_ LEFT JOIN counted c ON vec_id = c.a LEFT JOIN least t ON vec_id = t.a""",
    "op6_jaccard_join": r"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[0-9A-Za-z_]|[^\x00-\x7F])+') AS w FROM documents),
grams AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM worded),
sets AS (SELECT DISTINCT doc_id, g FROM grams), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS s FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b, s = p.n AND s = q.n AS same FROM shared JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 5 * s >= 4 * (p.n + q.n - s)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
counted AS (SELECT a, count(*) AS n, min(CASE WHEN same THEN b END) AS same FROM links GROUP BY a), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(same, doc_id)) AS class_id, coalesce(n, 0) AS n_links, least(doc_id, coalesce(b, doc_id)) AS group_id, doc_id <= coalesce(b, doc_id) AS kept
FROM documents LEFT JOIN counted c ON doc_id = c.a LEFT JOIN least t ON doc_id = t.a""",
    "op8_suffix_dedup": """WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, head, substring(h, 2 * head + 1, 2 * 1049) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 1000)) AS head FROM docs) b),
windows AS (SELECT doc_id, head + i AS i, hash(substring(part, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, head, part, unnest(range(0, least(1000, length(part) // 2 - 49))) AS i FROM blocks) w),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT doc_id, i FROM windows JOIN firsts USING (k) WHERE doc_id > first),
begun AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM gone),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM begun) r GROUP BY doc_id, run),
counts AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
edges AS (SELECT doc_id, s, e FROM runs UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM docs),
gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, e), 0) AS from_ FROM edges),
kept AS (SELECT d.doc_id, string_agg(substring(h, 2 * from_ + 1, 2 * (s - from_)), '' ORDER BY s, e) AS h FROM gaps g JOIN docs d ON g.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM docs d JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN counts c ON d.doc_id = c.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
