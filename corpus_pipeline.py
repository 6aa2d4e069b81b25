"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Null texts, empty
tables, repeated rows and extra columns are handled as the stages' operators state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from feedlens.llm import decontamination, mixing, sharding, simhash
from feedlens.llm import toxicity as tox
from feedlens.session import checkpoint_dir, ship_library
from feedlens.sources.tables import table

SHARDS = 16


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the Kneser-Ney models reject (score of 0.3 or more)."""
    ship_library(spark)
    return tox.without_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component (three-word shingles, two bits)."""
    ship_library(spark)
    return simhash.keep_one(docs, width=3, radius=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    ship_library(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (weights 1, 2, 3 by source; three epochs at most)."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with `size` and their `shard` of 16, contiguous by doc_id and near equal in bytes."""
    return sharding.assign(docs, SHARDS)


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("decontamination", decontaminate),
          ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written under the shared checkpoint folder."""
    ship_library(spark)
    out = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{out}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Toxicity and SimHash have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
