"""Writers. All overwrite what they write anew, so that a rerun doesn't repeat rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_by_week(df: DataFrame, path: str, week: str = "week") -> None:
    """One folder for each week: the weeks of `df` are replaced, other weeks at `path` stay. Later reads open theirs alone."""
    df.repartition(week).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(week).parquet(path)


def write_representation(df: DataFrame, folder: str, name: str, representation: str, window: int) -> str:
    """A representation table under {name}-{representation}{window}; returns the path."""
    df.write.mode("overwrite").parquet(path := f"{folder}/{name}-{representation}{window}")
    return path


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_summary(df: DataFrame, path: str) -> None:
    """Experiment summaries with nested fields as JSON."""
    df.write.mode("overwrite").json(path)


def write_rounds(parameters: DataFrame, path: str) -> None:
    """Model parameters of all rounds, a folder for each round."""
    parameters.repartition("round").write.mode("overwrite").partitionBy("round").parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset a new local folder takes its place, but only if driver and executors are one process (local mode);
    on a cluster every machine would have a folder of its own and lose the others' files, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
