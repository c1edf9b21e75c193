"""A training corpus from raw documents, stage by stage.

Toxic documents go, then documents that fail quality rules or stand on failing
hosts, then all but one of each group of near duplicates; passages that still
repeat are cut out, and what is left is packed into sequences.

Cases: null and empty texts fail the quality rules and go; of rows that repeat id
and text one stays; very long texts are read whole by every stage; columns of any
names are carried up to the last stage; empty documents or labels give no rows
or, without labels of both kinds, keep every document in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litforge.llm import ngram_join, packing, quality, suffix_dedup, toxicity
from litforge.session import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a lexicon learned from the labels doesn't find toxic."""
    lexicon, curve = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, lexicon, curve)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose host does."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that stand elsewhere too."""
    return suffix_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: SQL can't express learned lexicons, tokens or bins; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
