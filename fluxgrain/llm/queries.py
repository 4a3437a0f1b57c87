"""The queries of this subpackage and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, lines, lm, matroska, minhash, mixing, packing, repeats, topk, toxicity
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score, a decision and held_out of every document; labels of a third of the ids are never learnt from."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 greatest integer inner products of every twentieth vector against all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean per-token difference of cross-entropies of every document under the target's and the background's model."""
    return lm.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component and set size of every document: three-word shingles, a similarity of 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, share=85)


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as 8-bit samples in a Matroska stream, read back and digested."""
    return matroska.text_round_trip(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of at most 2,048 tokens and its place there."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with words: its tokens, whether it repeats an equal earlier line, and whether it is kept."""
    return lines.line_report(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document repeated to its source's target weight, with the number and the key of each copy."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "n_chars", "text", "mix_copy", "mix_copies", "mix_key")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without bytes of earlier-seen strings of 100 bytes."""
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_html_extraction, op2_toxicity, op3_exact_topk, op4_lm_scoring, op5_minhash_dedup, op6_matroska, op7_packing, op8_line_dedup, op9_source_mixing, op10_suffix_dedup)
    }


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0)))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_WEIGHTS = ", ".join(f"('{k}', {v})" for k, v in mixing.WEIGHTS.items())
OP9_SQL = f"""
WITH w(name, stated) AS (VALUES {_WEIGHTS}),
s AS (SELECT source AS src, sum(length(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY source),
t AS (SELECT src, size, coalesce(stated::DOUBLE, {mixing.DEFAULT_WEIGHT}) AS weight FROM s LEFT JOIN w ON src = name),
r AS (SELECT src, weight / (SELECT sum(weight) FROM t) * (SELECT sum(size) FROM t) / size AS rate FROM t),
u AS (SELECT d.*, rate, ('0x' || substr(md5(concat('{mixing.SEED}:', coalesce(doc_id::VARCHAR, 'null'))), 1, 13))::BIGINT / {float(1 << 52)} AS u
      FROM documents d JOIN r ON source IS NOT DISTINCT FROM src),
c AS (SELECT *, (SELECT count(*) FROM (SELECT k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (ORDER BY k) AS cdf FROM range(0, 200) g(k)) WHERE u >= cdf) AS mix_copies FROM u)
SELECT doc_id, source, lang, n_chars, text, k::INTEGER AS mix_copy, mix_copies::INTEGER AS mix_copies,
       ('0x' || substr(md5(concat('{mixing.SEED}s:', coalesce(doc_id::VARCHAR, 'null'), ':', k)), 1, 15))::BIGINT AS mix_key
FROM c, range(0, mix_copies) g(k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": OP3_SQL, "op8_line_dedup": lines.REPORT_SQL, "op9_source_mixing": OP9_SQL}
