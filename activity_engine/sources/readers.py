"""Readers of the raw files: activity logs, employees, psychometrics, answer keys, scores, experiment summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ACTIVITY_TYPES, COMMUNICATION, INSIDERS, PSYCHOMETRIC, SCORES, employee_schema, log_schema

DATE_FORMAT = "MM/dd/yyyy HH:mm:ss"


def file_name() -> Column:
    return F.col("_metadata.file_name")


def read_log(spark: SparkSession, path: str, version: str, activity: str) -> DataFrame:
    """One activity log with `type` and `ts`; quoted content (r6) is one field, as in standard CSV."""
    raw = spark.read.schema(log_schema(version, activity)).csv(path, header=True, quote='"', escape='"', multiLine=False)
    return raw.withColumn("type", F.lit(activity)).withColumn("ts", F.try_to_timestamp("date", F.lit(DATE_FORMAT)))


def read_weeks(spark: SparkSession, path: str, first: int, last: int, week: str = "week") -> DataFrame:
    """The weeks from `first` to `last` of what `write_by_week` wrote; other weeks' folders aren't opened."""
    return spark.read.parquet(path).filter(F.col(week).between(first, last))


def unite(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with unlike columns; absent values are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_activity(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """All five logs of a folder as one activity table."""
    return unite([read_log(spark, f"{folder}/{a}.csv", version, a) for a in ACTIVITY_TYPES])


def read_employees(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """Monthly snapshots; the month is the file's stem."""
    raw = spark.read.schema(employee_schema(version)).csv(folder, header=True)
    return raw.select("*", F.regexp_extract(file_name(), r"^(.*)\.csv", 1).alias("month"))


def read_psychometric(spark: SparkSession, path: str | None) -> DataFrame:
    """The five scores of each user; no path gives an empty table."""
    return spark.read.schema(PSYCHOMETRIC).csv(path, header=True) if path else spark.createDataFrame([], PSYCHOMETRIC)


def read_insiders(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The insider index of one dataset version (r4.2 is dataset 4.2), with scenario as a number and times parsed.

    Times of scenario 4 of version r6.2 lack the leading month digits 02.
    """
    raw = spark.read.schema(INSIDERS).csv(path, header=True).filter(F.col("dataset") == version[1:])
    start = F.when((F.lit(version) == "r6.2") & (F.col("scenario") == "4"), F.concat(F.lit("02"), "start")).otherwise(F.col("start"))
    time = lambda c: F.try_to_timestamp(c, F.lit(DATE_FORMAT))
    return raw.select(F.col("scenario").cast("int").alias("scenario"), "details", "user", time(start).alias("mstart"), time(F.col("end")).alias("mend"))


def read_index_answers(spark: SparkSession, folder: str, insiders: DataFrame, version: str) -> DataFrame:
    """(user, actid, details) of the detail files that the index of one version names, each for its own user alone.

    Files lie in a folder for each scenario in r4.2 and r5.2, and beside each other in the other versions.
    """
    named = insiders.select("scenario", "details").distinct().collect()  # a row an insider
    places = sorted({f"{folder}/r{version[1:]}-{r['scenario']}/{r['details']}" if version in ("r4.2", "r5.2") else f"{folder}/{r['details']}" for r in named})
    if not places:
        return spark.createDataFrame([], "user string, actid string, details string")
    return _details(spark.read.text(places)).join(insiders.select("user", "details").distinct(), ["user", "details"]).select("user", "actid", "details")


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    """(user, actid, details) of all detail files under a folder."""
    return _details(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder))


def _details(raw: DataFrame) -> DataFrame:
    """Lines are ragged and have no header: the fields after the type are id, date and user."""
    parts = F.split(F.regexp_replace("value", '"', ""), ",")
    return raw.select(F.trim(F.get(parts, F.lit(3))).alias("user"), F.trim(F.get(parts, F.lit(1))).alias("actid"), file_name().alias("details")).filter("user IS NOT NULL AND actid <> ''")


def read_features(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A feature or representation table."""
    return spark.read.csv(path, header=True, inferSchema=True) if format == "csv" else spark.read.format(format).load(path)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Experiment summaries, one JSON document in a file; files that don't parse are left out."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.filter("_corrupt_record IS NULL").drop("_corrupt_record") if "_corrupt_record" in raw.columns else raw


def read_communication(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMUNICATION).csv(path)


def read_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Per-user scores of all rounds; the round's number is in the file's name."""
    raw = spark.read.schema(SCORES).csv(folder, header=True)
    return raw.select(F.regexp_extract(file_name(), r"round_(\d+)", 1).cast("int").alias("round"), "*")
