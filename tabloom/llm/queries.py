"""One query for each training-data operator, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .ann import nearest_neighbours
from .decontaminate import contaminated
from .html_text import extract_text
from .langid import identify
from .line_dedup import line_dedup
from .mixing import mix_sources, oracle_mix
from .near_dup import near_duplicates
from .passages import repeated_passages
from .quality import score_quality
from .toxicity import score_toxicity


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op3_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_pruned_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(spark, vectors, vectors.where("vec_id % 20 = 0"))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, table(spark, sf_dir, "documents"))


def op7_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", F.col("score"))


def op9_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark, table(spark, sf_dir, "documents"))


def op10_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark, table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_template_decontamination, op2_order_minhash, op3_cuckoo_lines, op4_counterfactual_toxicity, op5_pruned_graph_neighbours,
            op6_poisson_mixing, op7_bradley_terry_quality, op8_language_mixture, op9_paragraph_minhash, op10_tree_scoring,
        )
    }


#: op3 by its contract: split, key, count documents, keep the largest one's lines, join again.
LINES_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
lines AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT a.*, coalesce(h.keeper <> a.doc_id, false) AS gone FROM keyed a LEFT JOIN hot h ON a.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_cuckoo_lines": LINES_SQL, "op6_poisson_mixing": oracle_mix("documents")}
