"""A pipeline for training documents: each stage is one operator, its result is written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from activity_engine.llm.common import freeing, new_path
from activity_engine.llm.decontaminate import keep_uncontaminated
from activity_engine.llm.mixing import mixed
from activity_engine.llm.near_dedup import keep_one
from activity_engine.llm.shard import shard
from activity_engine.llm.toxicity import keep_clean

SHARDS = 8


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go.

    Texts that are null, empty or without matches stay, whatever their length; equal texts share their fate, so repeated
    rows do. Null ids make no difference. An empty table gives no rows; columns are kept, whatever their names.
    """
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) one document of the least id stays.

    Documents without words (null, empty, blank) and rows with a null id all stay. Of repeated rows one stays; rows of
    one id whose texts aren't near stay each; among near texts of the least id the text's hash decides. Texts are
    compared whole. An empty table gives no rows; columns are kept, whatever their names.
    """
    return keep_one(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles go.

    Documents without words and rows with a null id stay; rows that repeat an id go together. Texts are searched whole,
    and items without words forbid nothing. An empty table gives no rows; columns are kept, whatever their names.
    """
    return keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents occur as often as the mix of sources takes them: not at all, once or twice.

    A null source is a source of its own. Documents without words occur as often as the block in which they begin; rows
    that repeat an id, and those with a null id, share one decision. Reruns agree. Texts are taken whole. An empty table
    gives no rows; columns are kept, whatever their names.
    """
    return mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot, the place in the shard's random order.

    Every row gets a slot, repeated rows one each; null ids are all of one shard, null and empty texts have size 1, and
    a text of any length is one record. An empty table gives no rows. Columns named shard or slot are replaced, all
    others kept, whatever their names.
    """
    return shard(docs, SHARDS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The toxicity model and the seeded choices of mixing and sharding can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; what a stage wrote on the way is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with freeing(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
