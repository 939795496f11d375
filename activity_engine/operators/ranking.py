"""Places and running sums over a whole table, without a task that sees all of it.

A window without groups, or with one huge group, sorts everything in one task. Here rows are first cut into ranges, the
ranges are summed up (a few hundred rows), and windows run within a range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import shared_path

RANGES = 256


def _kept(df: DataFrame, name: str) -> DataFrame:
    df.write.parquet(path := shared_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, order: list[str], name: str, store: Callable[[DataFrame, str], DataFrame] = _kept) -> DataFrame:
    """`df` with `name` long, each row's place by `order` from 0; equal rows take places in any order.

    The ranges are Spark's own; `store` writes them, as they may fall otherwise when they are made anew.
    """
    ranged = store(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + within).drop("_range", "_start")


def chunk_of(position: Column, n: Column, chunks: int) -> Column:
    """The chunk of a place when n rows are cut into `chunks` following ones, the larger ones first."""
    size, larger = F.floor(n / chunks), n % chunks
    edge = larger * (size + 1)
    return F.when(position < edge, F.floor(position / (size + 1))).otherwise(larger + F.floor((position - edge) / F.greatest(size, F.lit(1)))).cast("int")


def running_sums(df: DataFrame, by: list[str], order: str, sums: dict[str, str]) -> DataFrame:
    """`df` with {name: running sum of a column} by falling `order` (one row a value) within each group `by`.

    Groups are cut into RANGES ranges of `order` at its approximate quantiles, so that a group of any size, or the whole
    table (no `by`), is many tasks. Which quantiles they are doesn't change the sums.
    """
    cuts = [i / RANGES for i in range(1, RANGES)]
    keyed = df.withColumn("_all", F.lit(0))
    key = [*by, "_all"]
    bounds = keyed.groupBy(*key).agg(F.percentile_approx(order, cuts, 10 * RANGES).alias("_bounds"))
    ranged = keyed.join(bounds, key).withColumn("_range", F.size(F.filter("_bounds", lambda b: b > F.col(order)))).drop("_bounds")
    totals = ranged.groupBy(*key, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    totals = totals.select(*key, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    within = Window.partitionBy(*key, "_range").orderBy(F.desc(order))
    out = ranged.join(totals, [*key, "_range"]).withColumns({n: F.col(f"_b_{n}") + F.sum(c).over(within) for n, c in sums.items()})
    return out.drop("_all", "_range", *[f"_b_{n}" for n in sums])
