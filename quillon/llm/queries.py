"""Queries of the training-data operators, for the driver's contract.  ORACLES: DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, id_files, line_dedup, mixing, ngram_join, resampling, substring_dedup, token_counts, toxicity, vector_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """Path of the public byte-level vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op2_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.encode_and_read(_table(spark, sf_dir, "documents"), vocabulary())


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(_table(spark, sf_dir, "documents"), vocabulary(), token_counts.end_of(vocabulary()))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample_to_labelled_share(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(_table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


#: Shares of tokens by language that the mixing operator is run for.
MIXTURE = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), MIXTURE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_id_files": op2_token_id_files,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_quality_resampling": op6_quality_resampling,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
}

_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) i FROM w),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') k FROM p),
m AS (SELECT k, min(doc_id) o FROM g GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) j FROM g JOIN m USING (k) WHERE o < doc_id),
x AS (SELECT doc_id, unnest(ws) word, generate_subscripts(ws, 1) j FROM w),
t AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) kept, count(*) n FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.j = x.j WHERE c.j IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM w LEFT JOIN t USING (doc_id)""",
    "op7_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') k FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
o AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
f AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, f.y FROM r JOIN f ON r.node = f.x)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) n_shingles, min(node) component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1""",
}
