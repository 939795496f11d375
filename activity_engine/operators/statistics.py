"""Full statistics of the wide feature tables: minimum, maximum, median, mean and deviation of each value in each slice.

Medians and deviations don't add up as sums do, so what is merged are counts of values: actions are counted by (group, act,
time code, subtype, column, value) before the shuffle, these counts are summed by slice, and statistics are read from them.
A slice's values are cut into buckets, sixteen to an octave; only bucket totals are ordered across a slice, and a median
is looked up in the one or two buckets that hold its ranks. So a slice of any size is many rows of bounded size, and its
deviation is put together from the buckets' own, which keeps its digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .features import Feature, blocks, features

STATISTICS = ("min", "max", "med", "mean", "std")


def _bucket(value: Column) -> Column:
    """A number that never falls as the value rises."""
    return (F.signum(value) * (F.floor(F.log2(F.abs(value)) * 16) + 20_000)).cast("int")


def _at(values: Column, rank: Column) -> Column:
    """The value at a rank from 0 among sorted (v, n)."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))

    def step(a: Column, x: Column) -> Column:
        hit = (a["seen"] <= rank) & (a["seen"] + x["n"] > rank)
        return F.struct((a["seen"] + x["n"]).alias("seen"), F.when(hit, x["v"]).otherwise(a["v"]).alias("v"))

    return F.aggregate(values, start, step)["v"]


def order_statistics(counts: DataFrame, by: list[str], cell: list[str]) -> DataFrame:
    """(by, cell, min, max, med, mean, std) of counted values (by, cell, v double, n long); all rows of `by` come together.

    Rows may repeat a value. The median of an even number is the mean of the middle two; the deviation is the population's.
    """
    keys = [*by, *cell]
    v = counts.withColumn("_bucket", F.coalesce(_bucket(F.col("v")), F.lit(0))).repartition(*keys, "_bucket")
    v = v.groupBy(*keys, "_bucket", "v").agg(F.sum("n").alias("n"))
    v = v.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("v")).alias("_s"), F.sort_array(F.collect_list(F.struct("v", "n"))).alias("_v"))
    mean = F.col("_s") / F.col("_n")
    spread = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x["n"] * (x["v"] - F.col("_m")) * (x["v"] - F.col("_m")))
    v = v.withColumn("_m", mean).withColumn("_q", spread).repartition(*by)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(whole), "_mean": F.sum("_s").over(whole) / F.sum("_n").over(whole)})
    middle = lambda r: F.max(_at(F.col("_v"), F.floor(r) - F.col("_before")))
    gap = F.col("_m") - F.col("_mean")
    return v.groupBy(*keys).agg(
        F.min(F.col("_v")[0]["v"]).alias("min"),
        F.max(F.element_at("_v", -1)["v"]).alias("max"),
        ((middle((F.col("_all") - 1) / 2) + middle(F.col("_all") / 2)) / 2).alias("med"),
        F.max("_mean").alias("mean"),
        F.sqrt(F.sum(F.col("_q") + F.col("_n") * gap * gap) / F.max("_all")).alias("std"),
    )


def statistic_names(f: Feature) -> list[str]:
    """The five columns that stand for a mean, in their order."""
    stem = f.name[: -len(f"_mean_{f.column}")]
    return [f"{stem}_{s}_{f.column}" for s in STATISTICS]


def with_statistics(table: DataFrame, actions: DataFrame, by: list[str], mode: str, version: str = "r4.2", only: list[str] | None = None) -> DataFrame:
    """A feature table of the groups `by` with five statistics in the place of each mean; 0 where a slice has no values.

    Values that are null don't count.
    """
    means = [f for f in features(mode, version, only) if f.kind == "mean"]
    names = sorted({f.column for f in means})
    owner = {b.sub[0]: b.act for b in blocks(mode, version) if b.sub}
    subs = sorted({f.sub[0] for f in means if f.sub})
    slices = {x: i for i, x in enumerate(dict.fromkeys((f.act, f.times, f.sub) for f in means))}
    used = {act: [c for c in names if any(f.act == act and f.column == c for f in means)] for act in dict.fromkeys(f.act for f in means)}
    values = " ".join(f"WHEN act = {act} THEN array({', '.join(f'struct({names.index(c)} AS c, CAST(`{c}` AS DOUBLE) AS v)' for c in cs)})" for act, cs in used.items())
    keyed = actions.withColumns({s: F.when(F.col("act") == owner[s], F.col(s)) for s in subs}) if subs else actions
    counted = keyed.select(*by, "act", "time", *subs, F.expr(f"inline(CASE {values} END)")).filter("v IS NOT NULL")
    counted = counted.groupBy(*by, "act", "time", *subs, "c", "v").agg(F.count("*").alias("n"))

    def holds(act: int, times: tuple[int, ...] | None, sub: tuple[str, int] | None) -> str:
        parts = [f"act = {act}", *([f"time IN ({', '.join(map(str, times))})"] if times else []), *([f"{sub[0]} = {sub[1]}"] if sub else [])]
        return " AND ".join(parts)

    member = "filter(array(" + ", ".join(f"CASE WHEN {holds(*x)} THEN {i} END" for x, i in slices.items()) + "), x -> x IS NOT NULL)"
    cells = counted.withColumn("_slice", F.explode(F.expr(member))).select(*by, "_slice", "c", "v", "n")
    cells = order_statistics(cells, by, ["_slice", "c"])
    entry = F.struct((F.col("_slice") * len(names) + F.col("c")).alias("key"), *STATISTICS)
    found = cells.groupBy(*by).agg(F.collect_list(entry).alias("_cells")).select(F.struct(*by).alias("by"), "_cells")
    place = {f.name: i for i, f in enumerate(means)}
    at = np.full(len(slices) * len(names), -1)
    for f in means:
        at[slices[f.act, f.times, f.sub] * len(names) + names.index(f.column)] = place[f.name]
    width = len(means) * len(STATISTICS)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each group's cells as one array of all means' statistics, 0 where a slice has no values."""
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                lists = batch["_cells"]
                cells, row = lists.flatten(), np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
                dense, to = np.zeros((len(batch), len(means), len(STATISTICS))), at[cells.field("key").to_numpy()]
                for j, s in enumerate(STATISTICS):
                    dense[row, to, j] = cells.field(s).to_numpy(zero_copy_only=False)
                values = pa.ListArray.from_arrays(np.arange(0, dense.size + 1, width, dtype=np.int32), pa.array(dense.ravel()))
                yield pa.RecordBatch.from_arrays([*batch["by"].flatten(), values], [*by, "_stats"])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in found.schema["by"].dataType]).add("_stats", T.ArrayType(T.DoubleType()))
    joined = table.join(found.mapInArrow(spread, schema), by, "left")
    by_name = {f.name: f for f in means}

    def columns(name: str) -> list[Column]:
        """Written as SQL: hundreds of columns are built faster from text."""
        if name not in by_name:
            return [F.col(f"`{name}`")]
        first = place[name] * len(STATISTICS)
        return [F.expr(f"coalesce(get(_stats, {first + j}), 0D) AS `{n}`") for j, n in enumerate(statistic_names(by_name[name]))]

    return joined.select(*[x for name in table.columns for x in columns(name)])
