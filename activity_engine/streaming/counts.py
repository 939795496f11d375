"""Incremental counts of activity by user and period, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_events(spark: SparkSession, folder: str, file: str = "events.parquet", rows_per_trigger: int | None = None) -> DataFrame:
    """`events` as a stream of files; the pattern `file` may name many."""
    schema = spark.read.parquet(f"{folder}/{file}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def period_counts(stream: DataFrame, user: str, ts: str, period: str = "7 days", offset: str = "3 days", late: str = "1 day") -> DataFrame:
    """(user, start, n): counts of tumbling periods. With 7 days and an offset of 3, weeks begin on Sunday.

    A period's state is dropped once rows more than `late` after its end were seen; later rows of it are left out.
    """
    s = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return s.groupBy(F.window("_ts", period, startTime=offset).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), "n")


def run_to_parquet(counts: DataFrame, path: str) -> DataFrame:
    """Take what is new in the stream, and return all counts (user, start, n) so far.

    `path` holds the stream's state and its results: a later call with the same path goes on from there. Each batch
    writes the counts that it changed to a folder of its own, which a repeated batch replaces; the latest batch of a
    user and period has its count. State is kept for periods that the watermark hasn't passed.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result/batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    user = counts.columns[0]
    changes = counts.sparkSession.read.schema(f"`{user}` {counts.schema[user].dataType.simpleString()}, start timestamp, n long, batch long").parquet(f"{path}/result")
    return changes.groupBy(user, "start").agg(F.max_by("n", "batch").alias("n"))
