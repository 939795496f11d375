"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path
from .decontaminate import contamination
from .line_dedup import line_dedup
from .merkle import merkle_manifest, tampered, verified
from .mixing import mixture
from .near_dedup import near_duplicates
from .oracles import SQL as SQL
from .shard import shard, shard_of, write_shards
from .simhash import edited_fingerprints
from .substring_dedup import substring_dedup
from .tokens import token_counts
from .toxicity import toxicity
from .trie import placed_turns, prefix_trie, rebuilt
from .url_filters import rule_table, url_verdicts
from .warc import warc_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = write_shards(shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 8), new_path(spark, "shards"))
    text = F.coalesce("text", F.lit(""))
    grown = shard_of(F.col("doc_id").cast("long"), 9)
    return out.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).drop("source", "copies")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verified(merkle_manifest(docs, now=tampered(docs))).withColumnRenamed("id", "doc_id")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), rule_table(spark))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(placed_turns(table(spark, sf_dir, "conversations"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_sharding, op3_decontamination, op4_token_counts, op5_substring_dedup,
        op6_mixing, op7_warc, op8_line_dedup, op9_fingerprints, op10_toxicity,
        op11_merkle_manifest, op12_url_filters, op13_conversation_trie,
    )
}
