"""Wide feature tables by user-day, user-week and session, with generated names.

A table has about 500 features, too many conditional aggregates to run over raw actions. All are additive, so actions
are first summed by (group, act, time code, subtype): at most a few dozen rows a group, made in one pass before the
shuffle. A task then streams through its groups, batch by batch, and sums these rows once more by slice (block, period
and sub-slice: some fifty); the features are read from the slices' sums; means are quotients of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

FILE_NAMES = ["otherf", "compf", "phof", "docf", "txtf", "exef"]
HTTP_NAMES = ["otherf", "socnetf", "cloudf", "jobf", "leakf", "hackf"]
PERIODS = {
    "day": {"": None, "workhour": [1, 3], "afterhour": [2, 4]},
    "week": {"": None, "workhour": [1], "afterhour": [2], "weekend": [3, 4]},
    "session": {"": None},
}
ATTACHMENTS = [f"e_att_{s}{t}" for s in ("", "s") for t in ("other", "comp", "pho", "doc", "txt", "exe")]


@dataclass(frozen=True)
class Block:
    name: str
    act: int | None
    stats: tuple[str, ...] = ()
    counts: tuple[tuple[str, tuple[int, ...]], ...] = ()
    sub: tuple[str, tuple[int, ...], tuple[str, ...]] | None = None


@dataclass(frozen=True)
class Feature:
    """One column: the rows with `act`, `times` and `sub` value; kind n (rows), mean of `column`, or rows where it is `value`."""

    name: str
    kind: str
    act: int | None
    times: tuple[int, ...] | None
    sub: tuple[str, int] | None = None
    column: str = ""
    value: int = 0


def blocks(mode: str, version: str) -> list[Block]:
    new, session, r6 = version[1] in "56", mode == "session", version[1] == "6"
    pc = () if session else (("pc", (0, 1, 2, 3)),)
    file_new = (("to_usb", (1,)), ("from_usb", (1,)), ("file_act", (1, 2, 3, 4))) if new else ()
    email = ("n_des", "n_atts", "n_exdes", "n_bccdes", "email_size", "email_text_slen", "email_text_nwords") + (tuple(ATTACHMENTS) if new else ())
    types = (1, 2, 3, 4, 5, 6)
    return [
        Block("allact", None, (), pc),
        Block("logon", 1, (), pc),
        Block("usb", 3, ("usb_dur", "file_tree_len") if new else ("usb_dur",), pc),
        Block("file", 7, ("file_len", "file_depth", "file_nwords"), (*file_new, ("disk", (0, 1, 2) if session else (0, 1)), *pc), ("file_type", types, tuple(FILE_NAMES))),
        Block("email", 6, email, (("Xemail", (1,)), ("exbccmail", (1,)), *pc), ("send_mail", (0, 1), ("recvmail", "send_mail")) if new else None),
        Block("http", 5, ("url_len", "url_depth", "http_c_len", "http_c_nwords"), ((("http_act", (1, 2, 3)),) if r6 else ()) + pc, ("http_type", types, tuple(HTTP_NAMES))),
    ]


def features(mode: str, version: str = "r4.2", only: list[str] | None = None) -> list[Feature]:
    """All features in their order: block by block, period by period, the whole and then each sub-slice."""
    out = []
    for b in blocks(mode, version):
        if only and b.name not in only:
            continue
        for prefix, times in PERIODS[mode].items():
            t, name = tuple(times) if times else None, prefix + b.name
            slices = [(None, f"n_{name}", name)] + ([((b.sub[0], v), f"{name}_n_{s}", f"{name}_{s}") for v, s in zip(*b.sub[1:], strict=True)] if b.sub else [])
            for sub, count_name, stem in slices:
                out.append(Feature(count_name, "n", b.act, t, sub))
                out += [Feature(f"{stem}_mean_{c}", "mean", b.act, t, sub, c) for c in b.stats]
                out += [Feature(f"{stem}_n-{c}{v}", "count", b.act, t, sub, c, v) for c, vs in b.counts for v in vs]
    return out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero in binary, as SQL engines round doubles."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    whole += np.where(np.abs(y - whole) >= 0.5, np.sign(y), 0)
    return np.where(np.isfinite(y), whole / 10.0**digits, x) + 0.0


#: From a task's rows to its groups, batch by batch: what they are (`by` and `extra`), and a column for each feature.
Reader = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.StructArray, list[np.ndarray]]]]


def summed(
    actions: DataFrame, by: list[str], mode: str, version: str = "r4.2", only: list[str] | None = None, extra: dict[str, Column] | None = None, within: list[str] | None = None, digits: int | None = None
) -> tuple[DataFrame, Reader]:
    """Sums by group, dealt to tasks by `within` (columns of `by`, all by default) and ordered by `by`, and what makes features of them.

    What is summed depends on the act, so acts share a dozen columns of sums; what blocks of all acts count has its own.
    Means are rounded to `digits`.
    """
    wanted, extra = features(mode, version, only), extra or {}
    owner = {b.sub[0]: b.act for b in blocks(mode, version) if b.sub}
    subs = sorted({f.sub[0] for f in wanted if f.sub})
    measures = {None: sorted({(f.column, f.value) for f in wanted if f.act is None and f.kind == "count"})}
    for act in dict.fromkeys(f.act for f in wanted if f.act is not None):
        own = {(f.column, f.value if f.kind == "count" else None) for f in wanted if f.act == act and f.kind != "n"}
        measures[act] = sorted(own - set(measures[None]), key=str)
    common = len(measures[None])
    place = {(act, m): i + (common if act is not None else 0) for act, ms in measures.items() for i, m in enumerate(ms)}
    width = common + max((len(ms) for act, ms in measures.items() if act is not None), default=0)

    def sums(i: int) -> Column:
        number = lambda m: F.col(m[0]).cast("double") if m[1] is None else F.when(F.col(m[0]) == m[1], 1.0).otherwise(0.0)
        if i < common:
            return F.sum(number(measures[None][i]))
        cases = [F.when(F.col("act") == act, number(ms[i - common])) for act, ms in measures.items() if act is not None and i - common < len(ms)]
        return F.sum(F.coalesce(*cases))

    # A sub-slice column counts only for the block it belongs to; for other acts it would only split rows.
    sub = F.coalesce(F.lit(None).cast("int"), *[F.when(F.col("act") == owner[c], F.col(c).cast("int")) for c in subs])
    keyed = actions.withColumn("_sub", sub).groupBy(*by, "act", "time", "_sub")
    keyed = keyed.agg(F.count("*").alias("_rows"), *[sums(i).alias(f"_m{i}") for i in range(width)], *[c.alias(f"_x_{n}") for n, c in extra.items()])
    fold = {n: F.sum if "sum(" in str(c) else F.min if "min(" in str(c) else F.max for n, c in extra.items()}
    group = Window.partitionBy(*by).orderBy("act", "time")  # at most a few dozen rows
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = keyed.repartition(*(within or by)).withColumns({f"_x_{n}": f(f"_x_{n}").over(whole) for n, f in fold.items()} | {"_nth": F.row_number().over(group)})
    info = [F.col(f"`{c}`") for c in by] + [F.col(f"_x_{n}").alias(n) for n in extra]
    code = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c)
    numbers = [F.coalesce(F.col(f"_m{i}"), F.lit(0.0)).alias(f"_m{i}") for i in range(width)]
    dealt = dealt.select(F.struct(*info).alias("info"), code("act"), code("time"), code("_sub"), F.col("_rows").cast("double").alias("_rows"), *numbers, "_nth")

    slices: dict[tuple, list[tuple[int, int | None, bool]]] = {}
    for n, f in enumerate(wanted):
        m = (f.column, f.value if f.kind == "count" else None)
        at = None if f.kind == "n" else place.get((None, m), place.get((f.act, m)))
        slices.setdefault((f.act, f.times, f.sub and f.sub[1]), []).append((n, at, f.kind == "mean"))

    def read(t: pa.Table) -> tuple[pa.StructArray, list[np.ndarray]]:
        column = {c: t[c].to_numpy() for c in t.column_names if c != "info"}
        starts = column["_nth"] == 1
        g, n_groups = np.cumsum(starts) - 1, int(starts.sum())
        out: list[np.ndarray | None] = [None] * len(wanted)
        for (act, times, sub), cells in slices.items():
            here = np.ones(len(g), bool) if act is None else column["act"] == act
            if times:
                here &= np.isin(column["time"], times)
            if sub is not None:
                here &= column["_sub"] == sub
            at = np.flatnonzero(here)
            total = lambda c, at=at: np.bincount(g[at], column[c][at], n_groups)
            rows = total("_rows")
            for n, m, mean in cells:
                x = rows if m is None else total(f"_m{m}") if len(at) else rows
                out[n] = np.divide(x, rows, out=np.zeros(n_groups), where=rows > 0) if mean else x
                if mean and digits is not None and len(at):
                    out[n] = rounded(out[n], digits)
        return t["info"].combine_chunks().take(pa.array(np.flatnonzero(starts))), out

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, list[np.ndarray]]]:
        waiting = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            waiting = t if waiting is None else pa.concat_tables([waiting, t])
            last = np.flatnonzero(waiting["_nth"].to_numpy() == 1)[-1:]  # the last group may go on
            if len(last) and last[0]:
                yield read(waiting.slice(0, int(last[0])))
                waiting = waiting.slice(int(last[0]))
        if waiting is not None and len(waiting):
            yield read(waiting)

    return dealt, tables


def feature_table(
    actions: DataFrame, by: list[str], mode: str, version: str = "r4.2", only: list[str] | None = None, extra: dict[str, Column] | None = None, digits: int | None = None
) -> DataFrame:
    """One row a group with every feature; `extra` are further aggregates over actions (min, max and sum alone, as they nest)."""
    wanted = features(mode, version, only)
    dealt, groups = summed(actions, by, mode, version, only, extra, digits=digits)
    whole_numbers = [f.kind != "mean" for f in wanted]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in dealt.schema["info"].dataType])
    for f in wanted:
        schema = schema.add(f.name, "double" if f.kind == "mean" else "long")
    names = schema.fieldNames()

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for info, columns in groups(batches):
            columns = [pa.array(x.astype(np.int64) if w else x) for x, w in zip(columns, whole_numbers, strict=True)]
            yield pa.RecordBatch.from_arrays([*info.flatten(), *columns], names)

    return dealt.mapInArrow(tables, schema)


def label(insider: str = "insider", mal: str = "mal_act") -> dict[str, Column]:
    """Aggregates for a group's label; combine with `group_label`."""
    return {"_mal": F.max(mal), "_insider": F.max(insider)}


def group_label() -> Column:
    """The scenario if any action of the group is malicious, else 0."""
    return F.when(F.col("_mal") > 0, F.col("_insider")).otherwise(0)


def day_features(actions: DataFrame, version: str = "r4.2", only: list[str] | None = None) -> DataFrame:
    """The user-day table: bounds of the day, week, weekday and weekend flags, features, label."""
    midnight = F.unix_timestamp(F.date_trunc("day", F.col("ts")))
    extra = {"starttime": F.min(midnight), "week": F.min("week"), "_last": F.max("time")} | label()
    t = feature_table(actions, ["user", "day"], "day", version, only, extra)
    weekend = (F.col("_last") >= 3).cast("int")
    names = [f.name for f in features("day", version, only)]
    info = ["starttime", (F.col("starttime") + 86400).alias("endtime"), "user", "day", "week", (1 - weekend).alias("isweekday"), weekend.alias("isweekend")]
    return t.select(*info, *[F.col(f"`{n}`") for n in names], group_label().alias("insider"))


def week_features(actions: DataFrame, first_sunday: str, version: str = "r4.2", only: list[str] | None = None) -> DataFrame:
    """The user-week table; weeks begin on Sunday and the first, partial one (0) is left out."""
    t = feature_table(actions.filter("week >= 1"), ["user", "week"], "week", version, only, label())
    start = F.unix_timestamp(F.date_add(F.lit(first_sunday).cast("date"), F.col("week") * 7).cast("timestamp"))
    names = [f.name for f in features("week", version, only)]
    return t.select(start.alias("starttime"), (start + 7 * 86400).alias("endtime"), "user", "week", *[F.col(f"`{n}`") for n in names], group_label().alias("insider"))


def with_attributes(table: DataFrame, users: DataFrame, columns: list[str], after: str, user: str = "user") -> DataFrame:
    """A feature table with its users' organisation and psychometric columns, placed after the column `after`."""
    at = table.columns.index(after) + 1
    order = [*table.columns[:at], *columns, *table.columns[at:]]
    return table.join(users.select(user, *columns), user, "left").select(*[F.col(f"`{c}`") for c in order])


def slice_stats(actions: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Minimum, maximum, median, mean and population deviation of each column for each group."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.percentile(c, F.lit(0.5)).alias(f"med_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    return actions.groupBy(*by).agg(*aggs)


def slice_long(actions: DataFrame, by: list[str], slices: dict[str, Column], stats: list[str]) -> DataFrame:
    """The long form: one row for each group and slice that holds rows, with its count and means."""
    keys = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in slices.items()]), lambda x: x.isNotNull())
    return actions.withColumn("slice", F.explode(keys)).groupBy(*by, "slice").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in stats])
