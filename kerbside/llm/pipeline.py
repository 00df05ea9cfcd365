"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing to target weights, packing.

Each stage gets the documents that the one before it kept, as Parquet. All but the last return documents' own columns.

Defined results, stage by stage; the operators' docstrings say more. Null, empty and blank texts have no content, so that quality rules reject them; no
later stage of a run sees one. A null doc_id is scored, mixed and packed like any other, and passes both dedups untouched, as it cannot be
named. Very long texts are read whole and packed in pieces. Of equal texts, and of each group of near copies, the least doc_id stays, with one
row; rows that repeat doc_id and text are one document. A null source is a source of its own. An empty table gives empty results. Extra columns,
whatever their names, pass through all stages but the last, which returns its own.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from kerbside.llm import exact_dedup, mixing, packing, quality_rules, simhash
from kerbside.llm.frames import checkpoint_dir, table

#: What a row of a source is worth against one of another; the sources' sizes temper it (see mixing.tempered).
PRIORITIES = {f"src{k}": (1.0, 0.8, 0.6)[k % 3] for k in range(20)}
PRIORITY = 0.8  # of a source that is not listed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are mostly content; the others go."""
    return quality_rules.keep_good(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def target_weights(docs: DataFrame) -> dict:
    """The weight of each source that docs has."""
    return mixing.tempered(docs, PRIORITIES, default=PRIORITY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The most documents that the target weights of the sources allow, in shards, each shuffled."""
    return mixing.mixed_documents(docs, target_weights(docs), places=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: SQL has no conditional random field, SimHash trie or hypergeometric draw; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written as Parquet to the cluster's shared folder and read again for the next one.

    A folder is removed once the next one is written, the last one when the application ends, as the result reads it.
    """
    checkpoint_dir(spark)
    folder = os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"pipeline-{uuid.uuid4().hex}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(path(folder))
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            files.delete(path(f"{folder}/{k - 1}"), True)
    return STAGES[-1][1](spark, docs, sf_dir)
