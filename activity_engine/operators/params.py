"""Tables of model parameters (round, client_id, layer, idx, value): sparsifying, rounding, averaging, transport cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import positions
from .selection import comparable, kth_largest


def topk_sparsify(params: DataFrame, by: list[str], ratio: float, value: str = "value", order: str = "idx") -> DataFrame:
    """Keep the max(1, int(n * ratio)) largest absolute values of each group; the others become 0. Ties: smaller idx.

    The smallest value that stays is found by counting, and so is the last idx among those that equal it, where not all of
    these stay. Rows that repeat an idx there stay or go together. Infinite values and NaN are the largest, null the least.
    """
    rows = params.withColumn("_key", comparable(F.abs(value)))
    cut = kth_largest(rows, by, "_key", F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(ratio))))
    rows = rows.join(cut, by)
    tied = rows.filter("_key = cut AND wanted < equal").select(*by, "wanted", (-F.col(order)).cast("double").alias("_at"))
    last = kth_largest(tied, by, "_at", F.max("wanted")).select(*by, (-F.col("cut")).alias("_last"))
    keep = (F.col("_key") > F.col("cut")) | (F.col("_key") == F.col("cut")) & (F.col("_last").isNull() | (F.col(order) <= F.col("_last")))
    zero = F.lit(0).cast(params.schema[value].dataType)
    return rows.join(last, by, "left").withColumn(value, F.when(keep, F.col(value)).otherwise(zero)).select(*params.columns)


#: Half precision: exponents of normal numbers, bits after the point, and where rounding gets beyond the largest number.
_LOW, _HIGH, _BITS, _OVER = -14, 15, 10, 65520.0


def quantum(size: str) -> str:
    """SQL for the distance of half-precision numbers around `size`, a double of 0 or more."""
    steps = " ".join(f"WHEN {size} >= {2.0**e!r} THEN {2.0 ** (e - _BITS)!r}" for e in range(_HIGH, _LOW, -1))
    return f"CASE {steps} ELSE {2.0 ** (_LOW - _BITS)!r} END"


def quantize(params: DataFrame, value: str = "value") -> DataFrame:
    """Values rounded to half precision, as they arrive: to the nearest, ties to even; from 65520 on infinite.

    A value over the distance of half-precision numbers around it is a whole number after rounding; both are powers of two
    apart, so nothing else is rounded. Subnormal numbers have the distance of the least normal ones. Zeros keep their
    sign, NaN and null are what they were.
    """
    x = F.col(value).cast("double")
    size = F.abs(x)
    step = F.expr(quantum(f"abs(CAST(`{value}` AS DOUBLE))"))
    near = F.when(size >= _OVER, F.lit(float("inf"))).otherwise(F.rint(size / step) * step)
    rounded = F.when(F.isnan(x) | (x == 0), x).when(x < 0, -near).otherwise(near)
    return params.withColumn(value, rounded.cast(params.schema[value].dataType))


def chain(params: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply the client's steps in their order; no steps is the identity."""
    for step in steps:
        params = params.transform(step)
    return params


def chain_at_server(params: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Undo the client's steps: the server's steps, given in the client's order, are applied from the last to the first."""
    return chain(params, steps[::-1])


def transport_mb(params: DataFrame, by: list[str], item_bytes: int, sparse: bool, value: str = "value") -> DataFrame:
    """(by, mb): dense is every element; sparse is an index of 4 bytes and an item for each value that isn't 0."""
    n = F.count_if(F.col(value) != 0) * (4 + item_bytes) if sparse else F.count("*") * item_bytes
    return params.groupBy(*by).agg((n / F.lit(1024.0 * 1024.0)).alias("mb"))


def communication_cost(log: DataFrame) -> DataFrame:
    """(total_mb, mean_mb, uploads) of a communication log (kind, mb)."""
    return log.agg(F.sum("mb").alias("total_mb"), F.avg("mb").alias("mean_mb"), F.count("*").alias("uploads"))


def average(params: DataFrame, by: list[str], weight: str = "weight", value: str = "value") -> DataFrame:
    """Weighted mean of the clients' values for each parameter."""
    return params.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def weighted_metrics(metrics: DataFrame, by: list[str], columns: list[str], n: str) -> DataFrame:
    return metrics.groupBy(*by).agg(*[(F.sum(F.col(c) * F.col(n)) / F.sum(n)).alias(c) for c in columns])


#: Strides of the samples; a prime that doesn't divide the number of clients meets all of them.
STRIDES = [1009, 2003, 3001, 4001, 5003, 6007, 7001, 8009, 9001, 10007, 11003, 12007, 13001, 14009, 15013, 16001]


def sample_clients(rounds: DataFrame, clients: DataFrame, fraction: float = 0.5, least: int = 2) -> DataFrame:
    """(round, client_id): max(least, int(fraction * n)) different clients for each round, or all if there are fewer.

    Clients stand in the order of their hashes. A round begins at a place that its own hash gives, and takes every s-th
    place round the circle; s, too, comes from its hash. So a round makes just the rows that it returns, whatever the
    number of clients, and a rerun agrees.
    """
    named = clients.select("client_id", F.md5(F.col("client_id").cast("string")).alias("_hash"))
    placed = positions(named, ["_hash", "client_id"], "_place").select("client_id", "_place")
    n = placed.count()
    if not n:
        return rounds.select("round").join(placed.select("client_id"), F.lit(False))
    digest = F.md5(F.concat(F.lit("round "), F.col("round").cast("string")))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    free = [s for s in STRIDES if n % s]
    stride = F.get(F.array(*[F.lit(s) for s in free]), (part(9) % len(free)).cast("int"))
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(n, max(least, int(n * fraction))) - 1).cast("long")))
    drawn = rounds.select("round", part(1).alias("_start"), stride.cast("long").alias("_stride"), steps.alias("_step"))
    drawn = drawn.select("round", ((F.col("_start") + F.col("_step") * F.col("_stride")) % n).alias("_place"))
    return drawn.join(placed, "_place").select("round", "client_id")
