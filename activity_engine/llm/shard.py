"""Sharding by a two-pass external shuffle.

Pass 1 scatters records by seeded hashes into memory-sized buckets, a fixed number of buckets in each shard. Pass 2
shuffles every bucket by Fisher-Yates, numbers its records after those of the buckets before it, and `write_shards`
writes it. A record's shard depends on its id and the number of shards alone (rendezvous hashing), so that one more
shard takes rows only into itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import unused

BUCKET_BYTES = 16 << 20


def shard_of(id_column, shards: int, seed: int = 0):
    """The shard in 0 .. shards - 1 whose hash with the id is largest."""
    rivals = F.array(*[F.struct(F.xxhash64(id_column, F.lit(seed), F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(shards)])
    return F.array_max(rivals)["i"]


def _shuffler(seed: int, shard_col: str, slot_col: str, bucket: str, id_: str, tie: str):
    def shuffle(rows: pa.Table, offsets: pa.Table) -> pa.Table:
        """Put one bucket into a random order that depends on the seed and the bucket's records alone."""
        n = rows.num_rows
        rows = rows.take(pa.compute.sort_indices(rows, [(c, "ascending") for c in (id_, tie)]))
        key = (int(rows.column(shard_col)[0].as_py()), int(rows.column(bucket)[0].as_py())) if n else (0, 0)
        order = np.random.default_rng((seed, *key)).permutation(n)  # a Fisher-Yates shuffle
        first = int(offsets.column("first_slot")[0].as_py()) if offsets.num_rows else 0
        slot = pa.array(np.arange(first, first + n, dtype=np.int64))
        return rows.take(pa.array(order)).drop_columns([bucket, id_, tie]).append_column(slot_col, slot)

    return shuffle


def shard(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, bucket_bytes: int = BUCKET_BYTES,
    shard_col: str = "shard", slot_col: str = "slot",
) -> DataFrame:
    """Return `docs` with `shard_col` int and `slot_col` long, gapless from 0 in each shard, in shuffled order.

    Columns of `docs` named `shard_col` or `slot_col` are replaced; all others are carried along, whatever their names.
    Null ids are all of one shard; a null or empty text has size 1; a text of any length is one record. Repeated rows
    keep a slot each; records with equal ids and texts lie in one bucket. An empty table gives no rows.
    """
    docs = docs.drop(shard_col, slot_col)
    id_, tie, bucket = (unused(x, docs) for x in ("sort_id", "sort_text", "bucket"))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    placed = docs.withColumns({id_: F.col(id_col).cast("long"), tie: F.xxhash64(F.col(text_col))})
    placed = placed.withColumn(shard_col, shard_of(F.col(id_), shards, seed))
    placed = placed.withColumn(bucket, F.pmod(F.xxhash64(id_, tie, F.lit(seed + 1)), F.lit(buckets)).cast("long"))
    counts = placed.groupBy(shard_col, bucket).agg(F.count("*").alias("n"))
    before = Window.partitionBy(shard_col).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # Columns of its own for this side: it comes from the same rows as the other.
    offsets = counts.select(F.col(shard_col).alias("in_shard"), F.col(bucket).alias("in_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    schema = T.StructType([*docs.schema.fields, T.StructField(shard_col, T.IntegerType()), T.StructField(slot_col, T.LongType())])
    both = placed.groupBy(shard_col, bucket).cogroup(offsets.groupBy("in_shard", "in_bucket"))
    return both.applyInArrow(_shuffler(seed, shard_col, slot_col, bucket, id_, tie), schema)


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Write one folder of Parquet files for each shard, rows in slot order within a file; return what was written."""
    sharded.sortWithinPartitions(shard_col, slot_col).write.partitionBy(shard_col).parquet(path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path).select(*sharded.columns)
