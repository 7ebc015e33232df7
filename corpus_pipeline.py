"""Corpus pipeline: reject toxic documents, keep one of each near-copy group, drop benchmark leaks, mix, write ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  run() writes each result as Parquet to the shared folder and rereads it as the next one's docs.
Rows without an id are never dropped by id; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common, decontaminate, id_files, mixing, ngram_join, queries, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold of the toxicity classifier."""
    model, score = toxicity.train(docs, _table(spark, sf_dir, "labels")), common.free_name(docs, "_score")
    return toxicity.scored(docs, model, score_col=score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram similarity, the one of smallest id."""
    groups = ngram_join.link_components(docs)
    return common.drop_ids(docs, groups.filter("doc_id <> component_id").select("doc_id"), "doc_id")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark."""
    return common.drop_ids(docs, decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark")).select("doc_id"), "doc_id")


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that expected tokens by language meet the target shares; rates are 1 at least, so none is lost."""
    known = _table(spark, sf_dir, "labels").select("doc_id").distinct().join(docs.select("doc_id", "lang"), "doc_id")
    return mixing.repeated(docs, known, queries.MIXTURE, least=1.0, slack=0.05)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id shards with their index, read back."""
    return id_files.encode_and_read(docs, queries.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", one_of_each_group),
    ("decontamination", drop_leaks),
    ("mixing", mix_to_weights),
    ("token_ids", write_ids),
]

#: SQL can express neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
