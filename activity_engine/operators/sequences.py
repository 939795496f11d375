"""Clients, scaling, and sliding sequences of a user's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import model_input
from .ranking import chunk_of, positions


def client_partition(df: DataFrame, user: str, clients: int) -> DataFrame:
    """(user, client_id): sorted users in `clients` chunks, larger chunks first. Ranks distinct users alone."""
    placed = positions(df.select(user).distinct(), [user], "_place")
    n = placed.agg(F.count("*").alias("_n"))  # one row
    return placed.crossJoin(F.broadcast(n)).select(user, chunk_of(F.col("_place"), F.col("_n"), clients).alias("client_id"))


def select_features(df: DataFrame, wanted: list[str], info: list[str], absent: bool = False) -> DataFrame:
    """Info columns and the wanted features that are present (all others if none is wanted); `absent` adds the rest as 0."""
    have = [c for c in wanted if c in df.columns] if wanted else [c for c in df.columns if c not in info]
    extra = [F.lit(0.0).alias(c) for c in wanted if c not in df.columns] if absent else []
    return df.select(*[c for c in info if c in df.columns], *have, *extra)


def log_scale(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: model_input(F.col(f)) for f in features})


def fit_scaler(df: DataFrame, features: list[str], by: list[str], normal: str | None = "insider") -> DataFrame:
    """(by, feature, mean, std) over normal rows; population deviation."""
    rows = df.filter(F.col(normal) == 0) if normal else df
    return melt(rows, by, features).groupBy(*by, "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def melt(df: DataFrame, ids: list[str], features: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row for each feature."""
    return df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(ids, features, name, value)


def apply_scaler(df: DataFrame, scaler: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """Features less their mean, over their deviation (1 where that is 0). Rows of groups without a scaler go."""
    wide = scaler.groupBy(*by).pivot("feature", features).agg(F.first("mean").alias("m"), F.first("std").alias("s"))
    out = df.join(wide, by) if by else df.crossJoin(F.broadcast(wide))  # without groups the scaler is one row
    scaled = {f: (F.col(f) - F.col(f"{f}_m")) / F.when(F.col(f"{f}_s") == 0, 1.0).otherwise(F.col(f"{f}_s")) for f in features}
    return out.withColumns(scaled).drop(*[f"{f}_{x}" for f in features for x in "ms"])


def sequences(df: DataFrame, features: list[str], user: str, order: str, length: int = 14, stride: int = 1, keep: list[str] | None = None) -> DataFrame:
    """(user, start, seq): `length` following rows of a user as an array of arrays; a start every `stride` rows."""
    w = Window.partitionBy(user).orderBy(order)
    x = F.array(*[F.col(f).cast("double") for f in features])
    out = df.select(user, F.col(order).alias("start"), *(keep or []), x.alias("x"), F.row_number().over(w).alias("_n"), F.collect_list(x).over(w.rowsBetween(0, length - 1)).alias("seq"))
    return out.filter((F.size("seq") == length) & ((F.col("_n") - 1) % stride == 0)).drop("_n", "x")


def holdout_split(df: DataFrame, keys: list[str], percent: int = 20) -> DataFrame:
    """`df` with `held_out`, set for about `percent` of keys by the first digits of their md5: a rerun agrees."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    return df.withColumn("held_out", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 < percent).cast("int"))
