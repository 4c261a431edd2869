"""documents through language ID, near-dedup, decontamination, secret scans and mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's docs. All but the last return documents with the columns that they came with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from joinloom.llm import decontaminate, langid, mixing, secrets, similar, simhash
from joinloom.llm.common import dropped, scratch, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models accept; see langid.accepted(). The models learn from those of the
    documents that may be learned from, as in the operator's query; a corpus without labels stays whole."""
    return langid.accepted(spark, docs, langid.learn(langid.learned_rows(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that a similarity of 0.8 or more of 5-word shingles joins, the document with the
    smallest doc_id; see similar.near_duplicates() and simhash.one_of_each()."""
    return simhash.one_of_each(spark, docs, similar.near_duplicates)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no run of a window's words or more is the benchmark's; see
    decontaminate.clean()."""
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets masked; see secrets.masked()."""
    return secrets.masked(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how much of each document the mix takes, a row for
    each, also where that is nothing; see mixing.mix()."""
    return mixing.mixed(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mix),
]

#: Language models, SimHash and an automaton are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages make of documents. Each stage's result is written, and what was written on the way
    to it deleted; so is the result, once the next stage has read it."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as paths:
            docs, path = written(spark, stage(spark, docs, sf_dir), name)
            paths.remove(path)
        if last:
            dropped(spark, last)
        last = path
    return docs
