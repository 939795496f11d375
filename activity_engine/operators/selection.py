"""The k-th largest number of each group, by counting: no group is sorted, and none is seen whole by a task.

A group's numbers between two bounds are counted in CELLS cells of equal width. The cell that holds the k-th becomes the new
pair of bounds, as narrow as its own numbers are, until these are all equal. Counts are pre-aggregated, so a group that holds
nearly all rows is many tasks; a round reads only what fell into the cell of the round before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import _kept

CELLS = 256
#: Twice this is still finite.
_MOST = 1e307


def comparable(value: Column) -> Column:
    """A finite double in the value's order: infinite values and NaN count as the largest, null as the smallest."""
    v = value.cast("double")
    return F.when(v.isNull(), -_MOST).when(F.isnan(v) | (v > _MOST), _MOST).when(v < -_MOST, -_MOST).otherwise(v)


def kth_largest(rows: DataFrame, by: list[str], key: str, k: Column) -> DataFrame:
    """(by, cut, wanted, equal): each group's k-th largest `key`, how many of the rows that equal it are wanted, and how many do.

    `k` is made of aggregates over the group and of group columns, and is at least 1; a group with fewer rows gets its
    smallest. Keys are finite doubles (`comparable`).
    """
    keys = rows.select(*by, F.col(key).alias("_key"))
    first = rows.groupBy(*by).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"), F.count("*").alias("_n"), k.cast("long").alias("_k"))
    state = _kept(first.withColumn("_k", F.least("_k", "_n")), "select")
    found = None
    while True:
        done = state.filter("_lo = _hi").select(*by, F.col("_lo").alias("cut"), F.col("_k").alias("wanted"), F.col("_n").alias("equal"))
        found = done if found is None else found.union(done)
        state = state.filter("_lo < _hi")
        if state.isEmpty():
            return found
        place = F.floor((F.col("_key") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CELLS)
        keys = keys.join(state, by).filter("_key BETWEEN _lo AND _hi").withColumn("_cell", F.least(place, F.lit(CELLS - 1)).cast("int"))
        keys = _kept(keys.select(*by, "_key", "_k", "_cell"), "select")
        cells = keys.groupBy(*by, "_k", "_cell").agg(F.count("*").alias("_n"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi"))
        above = Window.partitionBy(*by).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)  # CELLS rows at most
        cells = cells.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0))).filter("_above < _k AND _k <= _above + _n")
        state = _kept(cells.select(*by, "_lo", "_hi", "_n", (F.col("_k") - F.col("_above")).alias("_k")), "select")
        keys = keys.select(*by, "_key")
