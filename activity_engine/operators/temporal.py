"""A user's periods against that user's own trailing history.

Features are carried as one array in a fixed order, so that hundreds of them need one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .features import features as feature_list
from .features import rounded, summed


def lag_concat(df: DataFrame, features: list[str], user: str, order: str, window: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Each row beside the features of the `window` - 1 rows before it, as -k_feature; the first `window` rows of a user go.

    (One row more goes than has to: rows are counted from 1 and those after `window` stay.)
    """
    w = Window.partitionBy(user).orderBy(order)
    lags = {f"_lag{k}": F.lag(F.struct(*[F.col(f"`{f}`") for f in features]), k).over(w) for k in range(window - 1, 0, -1)}
    out = df.withColumns({**lags, "_n": F.row_number().over(w)}).filter(F.col("_n") > window)
    info = [c for c in (keep or df.columns) if c not in features]
    return out.select(*[F.col(f"_lag{k}.`{f}`").alias(f"-{k}_{f}") for k in range(window - 1, 0, -1) for f in features], *features, *info)


#: Keys in a range, the unit of work; rows that a task takes at a time (whole ranges); numbers in a row's window from which
#: they are kept in trees; numbers in memory at a time where they are not.
RANGE, ROWS, MANY, BLOCK = 256, 4096, 1 << 15, 1 << 20


class Sliding:
    """Columns of numbers that enter and leave a window: how many are less than a value, and the k-th smallest.

    A Fenwick tree for each column, all in one array, over the ranks of the values that can ever enter. Every step takes
    log2(number of values) array operations over all columns, whatever the window's length. NaN is never in the window.
    """

    def __init__(self, values: np.ndarray):
        n, width = values.shape
        self.values, order = np.sort(values, axis=0), np.argsort(values, axis=0, kind="stable")
        new = np.ones((n, width), bool)
        new[1:] = self.values[1:] != self.values[:-1]
        rank = np.cumsum(new, axis=0)  # from 1; equal values share one
        self.rank = np.empty((n, width), np.int64)
        np.put_along_axis(self.rank, order, rank, axis=0)
        self.rank[np.isnan(values)] = 0
        self.first = np.zeros((n + 2, width))  # of each rank, its value
        np.put_along_axis(self.first, rank, self.values, axis=0)
        self.bits = max(1, int(n).bit_length())
        self.tree, self.columns = np.zeros(((1 << self.bits) + 1, width), np.int64), np.arange(width)
        self.size = np.zeros(width, np.int64)

    def add(self, row: int, by: int) -> None:
        at = self.rank[row].copy()
        inside = at > 0
        self.size += by * inside
        last = len(self.tree) - 1
        while inside.any():
            self.tree[at[inside], self.columns[inside]] += by
            at[inside] += at[inside] & -at[inside]
            inside = inside & (at <= last)

    def up_to(self, ranks: np.ndarray) -> np.ndarray:
        """How many values in the window have these ranks or less."""
        at, out = ranks.copy(), np.zeros(len(ranks), np.int64)
        while (at > 0).any():
            out += np.where(at > 0, self.tree[at, self.columns], 0)
            at -= at & -at
        return out

    def smallest(self, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value of each column, from 0; k is less than its size."""
        at, left = np.zeros(len(k), np.int64), k.copy()
        for b in range(self.bits, -1, -1):
            to = at + (1 << b)
            here = np.where(to < len(self.tree), self.tree[np.minimum(to, len(self.tree) - 1), self.columns], np.iinfo(np.int64).max)
            go = here <= left
            at, left = np.where(go, to, at), left - np.where(go, here, 0)
        return self.first[np.minimum(at + 1, len(self.first) - 1), self.columns]


def _means(x: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """`rows` of x minus the means of x[low:high] of each, windows side by side."""
    most, out = int((high - low)[rows].max()), np.empty((len(rows), x.shape[1]))
    step = max(1, BLOCK // (most * x.shape[1]))
    for a in range(0, len(rows), step):
        i = rows[a : a + step]
        at = low[i][:, None] + np.arange(most)
        h = np.where((at < high[i][:, None])[:, :, None], x[np.minimum(at, len(x) - 1)], np.nan)
        n = (~np.isnan(h)).sum(axis=1)
        out[a : a + step] = np.where(n > 0, x[i] - np.nansum(h, axis=1) / np.maximum(n, 1), np.nan)
    return out


def _gathered(x: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, find: str) -> np.ndarray:
    """Windows of few numbers: `rows` of x against x[low:high] of each.

    Most numbers are 0. How many of a window are less than 0 or 0 comes from running counts, which settle a 0's percentile
    and a median of 0; only the windows of the other numbers are laid side by side.
    """
    v, lo, hi = x[rows], low[rows], high[rows]
    most = int((hi - lo).max())

    def count(hit: np.ndarray) -> np.ndarray:
        running = np.zeros((len(x) + 1, x.shape[1]), np.int32)
        np.cumsum(hit, axis=0, dtype=np.int32, out=running[1:])
        return running[hi] - running[lo]

    def side_by_side(r: np.ndarray, c: np.ndarray):
        step = max(1, BLOCK // most)
        for a in range(0, len(r), step):
            i, j = r[a : a + step], c[a : a + step]
            at = lo[i][:, None] + np.arange(most)
            yield i, j, np.where(at < hi[i][:, None], x[np.minimum(at, len(x) - 1), j[:, None]], np.nan)

    less, zero = count(x < 0), count(x == 0)
    if find == "percentile":
        n = (hi - lo).astype(float)
        out = np.where(np.isnan(v), -50.0, (2 * less + zero) * 50.0 / n[:, None] - 50)
        for i, j, h in side_by_side(*np.nonzero((v != 0) & ~np.isnan(v))):
            own = v[i, j][:, None]
            out[i, j] = (2 * (h < own).sum(axis=1) + (h == own).sum(axis=1)) * 50.0 / n[i] - 50
        return out
    n = count(~np.isnan(x))
    out = np.where(n > 0, v, np.nan)
    settled = (less <= (n - 1) // 2) & (less + zero > n // 2)
    for i, j, h in side_by_side(*np.nonzero(~settled & (n > 0))):
        h.sort(axis=1)  # NaN comes last
        own, k = n[i, j], np.arange(len(i))
        out[i, j] -= (h[k, (own - 1) // 2] + h[k, own // 2]) / 2
    return out


def _slid(x: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, find: str) -> np.ndarray:
    """The same for one range by a tree that values enter and leave once."""
    first = int(low[rows[0]])
    s, lo, hi, out = Sliding(x[first : int(rows[-1]) + 1]), 0, 0, np.empty((len(rows), x.shape[1]))
    for n, i in enumerate(rows):
        a, b = int(low[i]) - first, int(high[i]) - first
        for j in range(lo, min(a, hi)):
            s.add(j, -1)
        for j in range(max(hi, a), b):
            s.add(j, 1)
        lo, hi = a, b
        if find == "median":
            some = s.size > 0
            k, m = np.where(some, (s.size - 1) // 2, 0), np.where(some, s.size // 2, 0)
            out[n] = np.where(some, x[i] - (s.smallest(k) + s.smallest(m)) / 2, np.nan)
        else:
            rank = s.rank[i - first]
            twice = s.up_to(np.maximum(rank - 1, 0)) + s.up_to(rank)
            out[n] = np.where(rank > 0, twice * 50.0 / (b - a) - 50, -50.0)
    return out


def _against(x: np.ndarray, hit: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray, find: str, many: int) -> np.ndarray:
    """The rows `hit` of x, each against x[low:high] of its group."""
    if not len(hit):
        return np.empty((0, x.shape[1]))
    if find == "mean":
        return _means(x, hit, low, high)
    if int((high - low)[hit].max()) * x.shape[1] <= many:
        return _gathered(x, hit, low, high, find)
    out = np.empty((len(hit), x.shape[1]))
    for g in np.unique(group[hit]):
        own = np.flatnonzero(group[hit] == g)
        out[own] = _slid(x, hit[own], low, high, find)
    return out


def _windows(t: np.ndarray, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the rows of its group with keys in [t - window, t - 1], from low to high; rows come by group and key."""
    key = group * (int(t.max()) - int(t.min()) + window + 2) + (t - t.min() + window + 1)
    return np.searchsorted(key, key - window, "left"), np.searchsorted(key, key, "left")


def _trailing(df: DataFrame, features: list[str], user: str, order: str, window: int, find: str) -> DataFrame:
    """`df` with each feature compared to its values at the user's keys [t - window, t - 1]; rows without history go.

    Rows come by user, cut into ranges of RANGE keys; each range has the `window` keys before it as well. A task streams
    through its ranges: rows carry no history, and memory is that of a few ranges. Windows of up to MANY numbers are laid
    side by side; larger ones live in a tree that values enter and leave once. A null or NaN counts as no value; a null
    key has no history.
    """
    keep = [c for c in df.columns if c not in features]
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    first = F.min("t").over(Window.partitionBy("who"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("keep"), F.col(user).alias("who"), F.col(order).cast("long").alias("t"), x.alias("x"))
    rows = rows.repartition("who").withColumn("first", first)
    rows = rows.withColumn("part", F.explode(F.sequence(F.floor(F.col("t") / RANGE), F.floor((F.col("t") + window) / RANGE))))
    width, many = len(features), MANY

    def compared(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        t, part = table["t"].to_numpy(), table["part"].to_numpy()
        x = np.asarray(table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(t), width)
        low, high = _windows(t, group, window)
        hit = np.flatnonzero((t // RANGE == part) & (t >= table["first"].to_numpy() + window) & (high > low))
        out = _against(x, hit, low, high, group, find, many)
        values = pa.array(out.ravel(), from_pandas=True)
        lists = pa.ListArray.from_arrays(np.arange(0, len(values) + 1, width, dtype=np.int32), values)
        kept = table["keep"].combine_chunks().take(pa.array(hit))
        kept = pa.StructArray.from_arrays(kept.flatten(), fields=[f.with_nullable(True) for f in kept.type])
        return pa.RecordBatch.from_arrays([kept, lists], ["keep", "x"])

    def groups(table: pa.Table) -> np.ndarray:
        who = table["who"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        part = table["part"].to_numpy()
        return np.concatenate([[0], np.cumsum((who[1:] != who[:-1]) | (part[1:] != part[:-1]))])

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) < ROWS:
                continue
            table = pa.Table.from_batches(waiting)
            g = groups(table)
            cut = int(np.searchsorted(g, g[-1]))  # the last range may go on
            if cut:
                yield compared(table.slice(0, cut), g[:cut])
            waiting = table.slice(cut).to_batches()
        if sum(map(len, waiting)):
            table = pa.Table.from_batches(waiting)
            yield compared(table, groups(table))

    kind = rows.schema["keep"].dataType.simpleString()
    out = rows.sortWithinPartitions("who", "part", "t").mapInArrow(slide, f"keep {kind}, x array<double>")
    return out.select(*[F.col(f"keep.`{c}`").alias(c) for c in keep], *[F.get("x", F.lit(i)).alias(f) for i, f in enumerate(features)]).select(*[F.col(f"`{c}`") for c in df.columns])


def trailing_features(actions: DataFrame, user: str, order: str, window: int, find: str, mode: str = "day", version: str = "r4.2", digits: int | None = None) -> DataFrame:
    """`percentile_rank` or `median_diff` (find: percentile, median) of the feature table by user and `order`.

    Features are made and compared in one task, which streams through its users' sums by key: no wide row is shuffled. It
    holds a batch and the rows of the user's window before it. Means, and what is returned, are rounded to `digits`.
    """
    names, many, size = [f.name for f in feature_list(mode, version)], MANY, ROWS
    dealt, groups = summed(actions.filter(F.col(order).isNotNull()), [user, order], mode, version, within=[user], digits=digits)
    fields = dealt.schema["info"].dataType.fields
    schema = T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, np.ndarray]]:
        for info, columns in groups(batches):
            for a in range(0, len(info), size):
                yield info.slice(a, size), np.stack([c[a : a + size] for c in columns], axis=1).astype(np.float64, copy=False)

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, pending = None, []

        def compared() -> pa.RecordBatch:
            nonlocal before
            parts = ([before[:2]] if before else []) + pending
            info, x = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            pending.clear()
            carried = len(before[0]) if before else 0
            who = info.field(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            t = info.field(1).cast(pa.int64()).to_numpy(zero_copy_only=False)
            head = np.append(True, who[1:] != who[:-1])
            group, first = np.cumsum(head) - 1, t[np.flatnonzero(head)]
            if before:
                first[0] = before[2]
            low, high = _windows(t, group, window)
            hit = np.flatnonzero((np.arange(len(t)) >= carried) & (t >= first[group] + window) & (high > low))
            out = _against(x, hit, low, high, group, find, many)
            stay = int(np.flatnonzero((group == group[-1]) & (t >= t[-1] - window))[0])
            before = (info.slice(stay), x[stay:].copy(), first[-1])
            out = np.ascontiguousarray((out if digits is None else rounded(out, digits)).T)
            return pa.RecordBatch.from_arrays([*info.take(pa.array(hit)).flatten(), *[pa.array(c, from_pandas=True) for c in out]], schema.fieldNames())

        for piece in pieces(batches):
            pending.append(piece)
            if sum(len(p[0]) for p in pending) >= (len(before[0]) if before else 0):  # a long window isn't gone through for each piece
                yield compared()
        if pending:
            yield compared()

    return dealt.mapInArrow(slide, schema)


def mean_diff(df: DataFrame, features: list[str], user: str, order: str, window: int) -> DataFrame:
    """Each feature minus its mean over the keys [t - window, t - 1]; rows with t >= first key + window and a history."""
    return _trailing(df, features, user, order, window, "mean")


def median_diff(df: DataFrame, features: list[str], user: str, order: str, window: int) -> DataFrame:
    """As `mean_diff`, with medians."""
    return _trailing(df, features, user, order, window, "median")


def percentile_rank(df: DataFrame, features: list[str], user: str, order: str, window: int, originals: list[str] | None = None) -> DataFrame:
    """Each feature's percentile in the trailing history, in [-50, 50]; `originals` are copied as org_*.

    It is (share of rows below the value + share at or below it) / 2 * 100 - 50.
    """
    df = df.withColumns({f"org_{c}": F.col(c) for c in originals or []})
    return _trailing(df, features, user, order, window, "percentile")


def percentile_rank_weekly(df: DataFrame, features: list[str], user: str, week: str, days: int, originals: list[str] | None = None) -> DataFrame:
    """Weekly rows: the window is whole weeks."""
    return percentile_rank(df, features, user, week, days // 7, originals)
