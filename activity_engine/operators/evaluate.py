"""Evaluation of score tables (score, label), for any number of groups (rounds) in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import running_sums


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _metrics(df: DataFrame) -> DataFrame:
    """Add quality measures to counts tp, fp, tn, fn; a division by 0 gives 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return df.withColumns({
        "precision": precision, "recall": recall, "f1": _ratio(2 * precision * recall, precision + recall),
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn), "balanced_accuracy": (recall + _ratio(tn, tn + fp)) / 2,
    })


def metrics_at_threshold(scores: DataFrame, threshold: float | Column, by: list[str] | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """Confusion counts and measures where a score of at least the threshold is a detection."""
    hit = F.col(score) >= threshold
    yes = F.col(label) == 1
    counts = scores.groupBy(*(by or [])).agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & ~yes).alias("tn"), F.count_if(~hit & yes).alias("fn"))
    return _metrics(counts)


def threshold_sweep(scores: DataFrame, thresholds: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """`metrics_at_threshold` for each threshold, in one pass over the scores."""
    each = scores.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return metrics_at_threshold(each, F.col("threshold"), ["threshold"], score, label)


def pr_curve(scores: DataFrame, by: list[str], score: str = "score", label: str = "label", steps: bool = False) -> DataFrame:
    """(by, threshold, tp, fp, precision, recall[, step]): one point for each distinct score; step is the growth of recall.

    Scores are grouped before the running sums, which run within ranges of scores.
    """
    points = scores.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(label).alias("_p"), F.count("*").alias("_n"))
    out = running_sums(points, by, "threshold", {"tp": "_p", "_seen": "_n"})
    hits = points.groupBy(*by).agg(F.sum("_p").alias("_hits"))
    out = out.join(hits, by) if by else out.crossJoin(F.broadcast(hits))  # without groups one row
    recall, step = _ratio(F.col("tp"), F.col("_hits")), _ratio(F.col("tp"), F.col("_hits")) - _ratio(F.col("tp") - F.col("_p"), F.col("_hits"))
    return out.select(*by, "threshold", "tp", (F.col("_seen") - F.col("tp")).alias("fp"), (F.col("tp") / F.col("_seen")).alias("precision"), recall.alias("recall"), *([step.alias("step")] if steps else []))


def average_precision(curve: DataFrame, by: list[str]) -> DataFrame:
    """(by, average_precision): sum of precision times the step in recall, without interpolation.

    A curve without steps gets them from a window over each group's points.
    """
    step = F.col("step") if "step" in curve.columns else F.col("recall") - F.coalesce(F.lag("recall").over(Window.partitionBy(*by).orderBy(F.desc("threshold"))), F.lit(0.0))
    return curve.withColumn("_a", step * F.col("precision")).groupBy(*by).agg(F.sum("_a").alias("average_precision"))


def best_f1(curve: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold, f1): the threshold of the best F1, the lowest one on ties."""
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    # Equal ratios can differ in the last bit, so ties are told on rounded values.
    key = F.struct(F.round(f1, 12).alias("a"), (-F.col("threshold")).alias("b"))
    top = curve.groupBy(*by).agg(F.max_by(F.struct("threshold", f1.alias("f1")), key).alias("m"))
    return top.select(*by, "m.threshold", "m.f1")


def round_summary(scores: DataFrame, round_: str = "round", score: str = "score", label: str = "label", even: bool = True) -> DataFrame:
    """One row for each (even) round: average precision, and counts and measures at the threshold of the best F1."""
    s = scores.filter(F.col(round_) % 2 == 0) if even else scores
    curve = pr_curve(s, [round_], score, label, steps=True)
    best = best_f1(curve, [round_]).select(round_, F.col("threshold").alias("_t"))
    m = metrics_at_threshold(s.join(best, round_), F.col("_t"), [round_, "_t"], score, label)
    return m.join(average_precision(curve, [round_]), round_).withColumnRenamed("_t", "optimal_threshold")


def last_rounds(scores: DataFrame, n: int = 5, round_: str = "round") -> DataFrame:
    """The rows of the last n rounds that occur."""
    last = scores.select(round_).distinct().orderBy(F.desc(round_)).limit(n)
    return scores.join(F.broadcast(last), round_, "left_semi")  # n rows


def best_round(summary: DataFrame, round_: str = "round", metric: str = "average_precision", share: float = 0.95) -> DataFrame:
    """(best_round, best, convergence_round): the earliest of the best rounds, and the first within `share` of it."""
    top = F.max(metric).over(Window.partitionBy())  # one row a round
    rows = summary.withColumn("_top", top)
    return rows.agg(F.min(F.when(F.col(metric) == F.col("_top"), F.col(round_))).alias("best_round"), F.max("_top").alias("best"), F.min(F.when(F.col(metric) >= share * F.col("_top"), F.col(round_))).alias("convergence_round"))


def experiment_rank(summaries: DataFrame, metric: str, name: str) -> DataFrame:
    """Experiments with their place by the metric, best first."""
    return summaries.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), name)))


def flatten_summaries(raw: DataFrame) -> DataFrame:
    """The comparison columns of nested experiment summaries."""
    m = lambda c: F.col(f"best_metrics.{c}").alias(c)
    return raw.select("experiment_name", m("pr_auc"), m("f1"), m("precision"), m("recall"), F.col("total_communication_mb").alias("total_mb"), "convergence_round")


def approach_compare(a: DataFrame, b: DataFrame, names: tuple[str, str], columns: list[str]) -> DataFrame:
    """(threshold, metric, {names}): two metric tables side by side at equal thresholds."""
    long = lambda d, n: d.select("threshold", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("threshold", columns, "metric", n)
    return long(a, names[0]).join(long(b, names[1]), ["threshold", "metric"])
