"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage works on what the stage before kept. The first four return documents with the
columns of the table; the last one returns shards and slots. Toxicity and
near duplicates can't be expressed in SQL. ``tests/llm`` holds the near-duplicate stage
against a plain version and checks rows and columns of the others, whose operators are
tested on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stormline.llm.common import table
from stormline.llm.decontaminate import drop_contaminated
from stormline.llm.mixing import sample_mix
from stormline.llm.ngram_join import keep_one
from stormline.llm.queries import SHARDS
from stormline.llm.sharding import shard_documents
from stormline.llm.toxicity import reject_toxic
from stormline.session import pinned


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample_mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs, [1.0] * SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
