"""Reconstruction errors of sequences, calibration, and anomaly scores of users.

A reconstruction is any table (window keys, t, feature, x, xhat). Two are built in: a group's feature means, and a
linear one from principal components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import z_score
from .ranking import _kept as kept


def explode_sequences(seqs: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, t, feature, x)."""
    rows = seqs.select(*keys, F.posexplode("seq").alias("t", "_row")).select(*keys, "t", F.posexplode("_row").alias("_i", "x"))
    return rows.withColumn("feature", F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_i") + 1)).drop("_i")


def mean_reconstruction(long: DataFrame, by: list[str]) -> DataFrame:
    """`long` with xhat, the mean of the feature in its group."""
    means = long.groupBy(*by, "feature").agg(F.avg("x").alias("xhat"))
    return long.join(means, [*by, "feature"])


def first_component_seed(j: Column, c: int) -> Column:
    """Where the iteration of component c begins: fixed numbers from -0.5 to 0.5 that look irregular."""
    return (j * 7919 + 104729 * (c + 1)) % 1009 / 1009.0 - 0.5


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)


def _plus(a: Column, times: Column, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x + times * y)


def _orthonormal(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Columns of each group made orthogonal to those before them and of length 1; what is left of no length becomes 0."""
    whole = Window.partitionBy(*by)  # as many rows as a window has numbers
    for i, n in enumerate(names):
        for before in names[:i]:
            rows = rows.withColumn("_d", F.sum(F.col(n) * F.col(before)).over(whole)).withColumn(n, F.col(n) - F.col("_d") * F.col(before))
        rows = rows.withColumn("_d", F.sqrt(F.sum(F.col(n) * F.col(n)).over(whole))).withColumn(n, F.when(F.col("_d") > 1e-9, F.col(n) / F.col("_d")).otherwise(0.0))
    return rows.drop("_d")


def principal_reconstruction(seqs: DataFrame, features: list[str], keys: list[str], by: list[str], k: int = 2, iterations: int = 6) -> DataFrame:
    """(keys, t, feature, x, xhat): windows projected on their group's k principal components, and back.

    seqs are (keys, seq) as `sequences` makes them; `by` are among the keys. The components come from a fixed number of
    subspace iterations from fixed starts: in each, every window is multiplied with its group's k vectors and adds itself,
    times these numbers, to the group's next vectors. These sums are made before the shuffle, so a group of any size
    sends a few rows a task; no matrix of window length squared is ever made, and what is joined to the windows is k
    vectors a group. A component that windows don't have is 0.
    """
    wide = kept(seqs.select(*keys, F.flatten("seq").alias("x")), "windows")
    names = [f"_v{c}" for c in range(k)]
    means = wide.select(*by, F.posexplode("x").alias("j", "v")).groupBy(*by, "j").agg(F.avg("v").alias("_m"))
    rows = kept(means.withColumns({n: first_component_seed(F.col("j"), c) for c, n in enumerate(names)}), "components")

    def arrays(rows: DataFrame) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct("j", "_m", *names)))
        g = _orthonormal(rows, by, names).groupBy(*by).agg(listed.alias("_rows"))
        return kept(g.select(*by, *[F.col("_rows")[n].alias(n) for n in ("_m", *names)]), "components")

    model = arrays(rows)

    def projected() -> DataFrame:
        centred = wide.join(model, by).withColumn("_c", F.zip_with("x", "_m", lambda x, m: x - m))
        return centred.withColumns({f"_y{c}": _dot("_c", n) for c, n in enumerate(names)})

    for _ in range(iterations):
        sums = projected().select(*by, *[f"_y{c}" for c in range(k)], F.posexplode("_c").alias("j", "v")).groupBy(*by, "j").agg(*[F.sum(F.col("v") * F.col(f"_y{c}")).alias(n) for c, n in enumerate(names)])
        model = arrays(sums.join(rows.select(*by, "j", "_m"), [*by, "j"]))
    back = F.col("_m")
    for c, n in enumerate(names):
        back = _plus(back, F.col(f"_y{c}"), n)
    cells = projected().select(*keys, F.posexplode(F.zip_with("x", back, lambda a, b: F.struct(a.alias("x"), b.alias("xhat")))).alias("j", "s"))
    width = len(features)
    feature = F.element_at(F.array(*[F.lit(f) for f in features]), (F.col("j") % width + 1).cast("int"))
    return cells.select(*keys, F.floor(F.col("j") / width).cast("int").alias("t"), feature.alias("feature"), "s.x", "s.xhat")


def errors(recon: DataFrame, keys: list[str], absolute: bool = False) -> DataFrame:
    """(keys, feature, err): mean squared or absolute error of each feature over a window."""
    gap = F.col("x") - F.col("xhat")
    return recon.groupBy(*keys, "feature").agg(F.avg(F.abs(gap) if absolute else gap * gap).alias("err"))


def window_mse(recon: DataFrame, keys: list[str]) -> DataFrame:
    return recon.groupBy(*keys).agg(F.avg(F.pow(F.col("x") - F.col("xhat"), 2)).alias("mse"))


def calibration(errs: DataFrame, by: list[str]) -> DataFrame:
    """(by, feature, mean, std) of errors."""
    return errs.groupBy(*by, "feature").agg(F.avg("err").alias("mean"), F.stddev_pop("err").alias("std"))


def trimmed_stats(errs: DataFrame, top: float = 0.01, store: Callable[[DataFrame, str], DataFrame] = kept) -> DataFrame:
    """(feature, mean, std) without the largest `top` share of errors: the first int(n * (1 - top)) by size stay.

    `store` writes the errors: they are read several times, and sums made anew may differ in their last digit, which would
    put errors at the cut on both sides of it.

    Which of equal errors stay makes no difference, so errors are counted by value and ranked near the cut alone:
    approximate quantiles 1 % of the rows below and above it surely enclose it (they are right to 0.1 %; of fewer than
    1,000 rows all are near).
    """
    errs = store(errs.select("feature", "err"), "errors")
    near = [max(0.0, 1 - top - 0.01), min(1.0, 1 - top + 0.01)]
    sums = errs.groupBy("feature").agg(F.count("*").alias("_n"), F.percentile_approx("err", near, 1000).alias("_q"), F.min("err").alias("_min"), F.max("err").alias("_max"))
    sums = sums.select("feature", F.floor(F.col("_n") * F.lit(1 - top)).alias("_kept"), F.when(F.col("_n") < 1000, F.col("_min")).otherwise(F.get("_q", F.lit(0))).alias("_lo"), F.when(F.col("_n") < 1000, F.col("_max")).otherwise(F.get("_q", F.lit(1))).alias("_hi"))
    placed = errs.join(F.broadcast(sums), "feature")  # one row a feature
    below = placed.filter("err < _lo").groupBy("feature").agg(F.count("*").alias("_below"))
    values = placed.filter("err BETWEEN _lo AND _hi").groupBy("feature", "_kept", "err").agg(F.count("*").alias("_c"))
    up = Window.partitionBy("feature").orderBy("err")  # the values of a fiftieth of the rows
    ranked = values.join(F.broadcast(below), "feature", "left").withColumn("_upto", F.coalesce("_below", F.lit(0)) + F.sum("_c").over(up))
    ranked = ranked.withColumn("_take", F.least("_c", F.col("_kept") - (F.col("_upto") - F.col("_c"))))
    cut = ranked.filter("_take > 0").groupBy("feature").agg(F.max(F.struct("err", "_take")).alias("_cut"))
    inside = placed.join(F.broadcast(cut), "feature").filter("err < _cut.err")
    inside = inside.groupBy("feature").agg(F.count("*").alias("_m"), F.avg("err").alias("_a"), F.stddev_pop("err").alias("_d"))
    both = cut.join(inside, "feature", "left").select("feature", F.col("_cut.err").alias("_e"), F.col("_cut._take").cast("double").alias("_t"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("_m", "_a", "_d")])
    mean = (F.col("_m") * F.col("_a") + F.col("_t") * F.col("_e")) / (F.col("_m") + F.col("_t"))
    both = both.withColumn("mean", mean)
    square = F.col("_m") * (F.pow("_d", F.lit(2)) + F.pow(F.col("_a") - F.col("mean"), 2)) + F.col("_t") * F.pow(F.col("_e") - F.col("mean"), 2)
    return both.select("feature", "mean", F.sqrt(square / (F.col("_m") + F.col("_t"))).alias("std"))


def top_mean(values: Column, k: int) -> Column:
    """Mean of the k largest values of an array."""
    largest = F.slice(F.sort_array(values, asc=False), 1, k)
    return F.aggregate(largest, F.lit(0.0), lambda s, x: s + x) / F.size(largest)


def window_scores(errs: DataFrame, calib: DataFrame | None, keys: list[str], by: list[str], top: int = 5, high: float = 2.0, diversity: bool = True, default: tuple[float, float] = (0.02, 0.05)) -> DataFrame:
    """(keys, score): mean of the `top` largest positive z of a window, times 1 + the share of z above `high`.

    Groups without calibration take the default mean and deviation.
    """
    if calib is None:
        j = errs.withColumns({"mean": F.lit(default[0]), "std": F.lit(default[1])})
    else:
        j = errs.join(calib, [*by, "feature"], "left").withColumns({"mean": F.coalesce("mean", F.lit(default[0])), "std": F.coalesce("std", F.lit(default[1]))})
    z = F.greatest(z_score(F.col("err"), F.col("mean"), F.col("std")), F.lit(0.0))
    # A window has as many rows as features: the array is bounded by their number.
    w = j.withColumn("z", z).groupBy(*keys).agg(F.collect_list("z").alias("zs"))
    factor = 1 + F.size(F.filter("zs", lambda v: v > high)) / F.size("zs") if diversity else F.lit(1.0)
    return w.select(*keys, (top_mean(F.col("zs"), top) * factor).alias("score"))


def user_scores(windows: DataFrame, labels: DataFrame, user: str, order: str, worst: int = 3, metric: tuple[float, float] | DataFrame | None = None) -> DataFrame:
    """(user, max_z_score, is_actual_insider): mean of a user's `worst` windows, normalised by a metric's (mean, std).

    Users without windows score 0. `labels`: (user, insider) rows; any row that isn't 0 makes an insider.
    """
    w = Window.partitionBy(user).orderBy(F.desc("score"), order)
    best = windows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= worst).groupBy(user).agg(F.avg("score").alias("_s"))
    if isinstance(metric, DataFrame):
        best = best.crossJoin(F.broadcast(metric.select(F.col("mean").alias("_m"), F.col("std").alias("_d"))))  # one row
        best = best.withColumn("_s", z_score(F.col("_s"), F.col("_m"), F.col("_d"))).drop("_m", "_d")
    elif metric:
        best = best.withColumn("_s", z_score(F.col("_s"), F.lit(metric[0]), F.lit(metric[1])))
    truth = labels.groupBy(user).agg(F.max((F.col("insider") != 0).cast("int")).alias("is_actual_insider"))
    return truth.join(best, user, "left").select(user, F.coalesce("_s", F.lit(0.0)).alias("max_z_score"), "is_actual_insider")


def top_errors(errs: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """(keys, metric): mean of a window's `top` largest errors."""
    return errs.groupBy(*keys).agg(F.collect_list("err").alias("e")).select(*keys, top_mean(F.col("e"), top).alias("metric"))


def self_z_scores(mse: DataFrame, labels: DataFrame, user: str) -> DataFrame:
    """(user, peak_z, is_insider), a row for each user of either table: the largest error against the user's own windows.

    Users without windows, or whose windows differ by rounding alone, score 0.
    """
    both = labels.select(user, (F.col("insider") == 1).cast("int").alias("is_insider")).unionByName(mse.select(user, "mse"), allowMissingColumns=True)
    peak = [F.max("mse").alias("hi"), F.min("mse").alias("lo"), F.avg("mse").alias("m"), F.stddev_pop("mse").alias("d")]
    s = both.groupBy(user).agg(F.max("is_insider").alias("is_insider"), *peak)
    differ = F.col("hi") - F.col("lo") > 1e-12 * F.greatest("hi", F.lit(1.0))
    return s.select(user, F.when(differ, (F.col("hi") - F.col("m")) / F.col("d")).otherwise(0.0).alias("peak_z"), "is_insider")


def peak_ratio(mse: DataFrame, labels: DataFrame, user: str, known: list | None = None, normals: int = 10) -> DataFrame:
    """(bad_mean, normal_mean, ratio) of users' peak errors: bad users against the first `normals` other users.

    Bad users are the known ones that occur, else the labelled insiders; only peaks above 0 count.
    """
    peaks = mse.groupBy(user).agg(F.max("mse").alias("peak"))
    users = labels.groupBy(user).agg(F.max((F.col("insider") != 0).cast("int")).alias("_bad"))
    listed = F.trim(F.col(user).cast("string")).isin([str(k).strip() for k in known or ["\0"]])
    users = users.crossJoin(F.broadcast(users.agg(F.max(listed.cast("int")).alias("_listed"))))  # one row
    bad = users.withColumn("_bad", F.when(F.col("_listed") == 1, listed.cast("int")).otherwise(F.col("_bad")))
    first = bad.filter("_bad = 0").select(user).orderBy(user).limit(normals)
    chosen = bad.filter("_bad = 1").select(user, F.lit(1).alias("_b")).union(first.withColumn("_b", F.lit(0)))
    j = chosen.join(peaks, user).filter("peak > 0")
    m = j.agg(F.avg(F.when(F.col("_b") == 1, F.col("peak"))).alias("bad_mean"), F.avg(F.when(F.col("_b") == 0, F.col("peak"))).alias("normal_mean"))
    return m.withColumn("ratio", F.try_divide("bad_mean", "normal_mean"))
