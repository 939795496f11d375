"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Targets are shares of `total` times all tokens by weight, none above `most` times its source's tokens (the excess is
reshared by weight). A source is cut into shards of bounded size by a hash of the id, so a source that holds a third
of all rows is many groups. Blocks are dealt to sources, then to each source's shards, by highest quotients
w / (2 s + 1), which gives integer quotas per shard. A shard lays its documents in a seeded order, cuts the line into
equal blocks, takes each block quota // blocks times, and a seeded choice of blocks once more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_REGEX, unused, written

SHARD_WORDS, SHARD_ROWS = 8 << 20, 1 << 20


def source_targets(sizes: DataFrame, weights: tuple[float, ...], total: float, most: float) -> DataFrame:
    """From (source, source_size, ...) of each source, the same with `target` double: water-filling under caps.

    With sources in the order of cap / weight the capped ones come first; the first source k whose cap / weight exceeds
    (goal - caps before k) / (weights from k on) fixes the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(total)))
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("goal") - F.col("before")) / F.col("rest"))
    s = s.withColumn("nth", F.when(F.col("cap") / F.col("w") > F.col("level"), F.row_number().over(by_level)))
    s = s.withColumn("level", F.min_by("level", "nth").over(everything))
    return s.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap")))).drop("w", "cap", "goal", "before", "rest", "level", "nth")


def sainte_lague(parties: DataFrame, by: list[str], key: list[str], quota: str, cap: str, seats: str, name: str) -> DataFrame:
    """Deal `seats` (one number per group `by`) to parties by highest quotients; `quota` is a party's exact share.

    No party gets more than `cap`, none of quota 0 gets any. Ties go to the smaller key.

    At x seats for each unit of quota a party has quota * x seats, give or take a half, or its cap. So the last seat
    goes between `_low`, where even half a seat more for each party is in the house, and `_high`, where half a seat less
    for each still fills it: water-filling as in `source_targets`. Quotients between these are ranked, a few a party
    on the whole, however unequal the parties are. All this is one pass over the parties, without a join: a plan that
    holds them twice would be twice the driver's work wherever seats are dealt within seats.
    """
    some, q, c = F.col(quota) > 0, F.col(quota), F.col(cap)
    group, tie = Window.partitionBy(*by), [F.col(k) for k in key]
    p = parties.withColumn("_bound", F.when(some, (c + 0.5) / F.when(some, q)))
    first = group.orderBy(F.col("_bound").asc_nulls_last(), *tie).rowsBetween(Window.unboundedPreceding, -1)
    last = group.orderBy(F.col("_bound").desc_nulls_first(), *[k.desc() for k in tie]).rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("_before", F.coalesce(F.sum(F.when(some, c)).over(first), F.lit(0)))
    level = (F.col(seats) - F.col("_before") + F.count(F.when(some, 1)).over(last) / 2) / F.sum(F.when(some, q)).over(last)
    p = p.withColumn("_level", F.when(some, level))
    high = F.min(F.when(F.col("_bound") >= F.col("_level"), F.struct("_bound", *key, "_level"))).over(group)["_level"]
    low = F.greatest((F.col(seats) - F.count(F.when(some, 1)).over(group) / 2) / F.sum(F.when(some, q)).over(group), F.lit(0.0))
    p = p.withColumns({"_high": F.coalesce(high, F.max("_bound").over(group)), "_low": F.when(some, low)})
    # One seat beyond both ends, for rounding.
    near = lambda x, more: F.when(some, F.least(F.greatest(F.floor(q * F.col(x) + 0.5).cast("long") + more, F.lit(0)), c)).otherwise(0)
    p = p.withColumns({"_sure": near("_low", -1), "_most": near("_high", 1)})
    p = p.withColumn("_left", F.col(seats) - F.sum("_sure").over(group)).drop("_bound", "_before", "_level", "_high", "_low")
    # A party with nothing left to win has one row without a seat, which ranks behind all seats.
    tried = p.withColumn("_seat", F.explode_outer(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_most") - 1))))
    ranked = tried.withColumn("_rank", F.row_number().over(group.orderBy((q / (2 * F.col("_seat") + 1)).desc_nulls_last(), *key, "_seat")))
    dealt = ranked.groupBy(*parties.columns, "_sure").agg(F.count_if(F.col("_seat").isNotNull() & (F.col("_rank") <= F.col("_left"))).alias("_won"))
    return dealt.withColumn(name, F.col("_sure") + F.col("_won")).drop("_sure", "_won")


def _taker(seed: int):
    def take(rows: pd.DataFrame) -> pd.DataFrame:
        """Words taken of each document of one shard."""
        rows = rows.sort_values(["place", "id", "size"], kind="stable", na_position="last").reset_index(drop=True)
        size, n, quota = int(rows["size"].sum()), int(rows["blocks"].iat[0]), int(rows["quota"].iat[0])
        taken, copies = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64)
        if size and n:
            edges = np.arange(n + 1, dtype=np.int64) * size // n
            times = np.full(n, quota // n, np.int64)
            rng = np.random.default_rng((seed, int(rows["shard"].iat[0]), size))
            times[rng.permutation(n)[: quota % n]] += 1
            sums = np.concatenate(([0], np.cumsum(times * np.diff(edges))))
            ends = np.concatenate(([0], np.cumsum(rows["size"].to_numpy(np.int64))))
            block = np.minimum(np.searchsorted(edges, ends, side="right") - 1, n - 1)
            copies = times[block[:-1]]
            taken = np.diff(sums[block] + times[block] * (ends - edges[block]))
        return rows.assign(taken=taken, copies=copies)[["id", "key", "size", "taken", "copies"]]

    return take


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2, block: int = 64, seed: int = 0,
) -> DataFrame:
    """Return (doc id, source, size, source_size, target, taken, copies), one row per input row.

    `copies` is how often the block is taken in which the document begins: what a mix of whole documents takes.

    `size` counts words (null: 0); sources are ordered by code point, null last (a source of its own), and weights
    repeat along that order. `taken` counts words, repeats included, and is at most `most` (an integer) times the
    document's size. Reruns agree. Documents without words take nothing; repeated rows are documents of their own;
    null ids are allowed. If no document has words all targets are 0. Empty tables give no rows.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_REGEX)).cast("long")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    base = written(base.withColumn("key", key).withColumn("place", F.xxhash64(F.lit(seed), "id", "size")), "sizes")

    sources = base.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    cuts = F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("rows") / SHARD_ROWS), F.lit(1)).cast("long")
    sources = written(source_targets(sources, weights, total, most).withColumn("cuts", cuts), "targets")
    dealt = base.join(sources.select("key", "cuts"), "key").withColumn("shard", F.pmod("place", "cuts"))

    blocks = F.when(F.col("words") > 0, F.greatest(F.round(F.col("words") / block).cast("long"), F.lit(1))).otherwise(F.lit(0))
    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("words")).withColumn("blocks", blocks)
    per_source = shards.groupBy("key").agg(F.sum("blocks").alias("all_blocks")).join(sources, "key").filter("source_size > 0")
    per_source = per_source.withColumn("share", F.col("target") * F.col("all_blocks") / F.col("source_size")).withColumn("cap", (F.col("all_blocks") * int(most)).cast("long"))
    per_source = per_source.withColumn("house", F.round(F.sum("share").over(Window.partitionBy())).cast("long"))
    seats = sainte_lague(per_source, [], ["key"], "share", "cap", "house", "seats").select("key", "seats", "all_blocks")
    per_shard = shards.join(seats, "key").withColumn("share", F.col("seats") * F.col("blocks") / F.col("all_blocks")).withColumn("cap", (F.col("blocks") * int(most)).cast("long"))
    quotas = written(sainte_lague(per_shard, ["key"], ["key", "shard"], "share", "cap", "seats", "quota").select("key", "shard", "blocks", "quota"), "quotas")

    lines = dealt.join(quotas, ["key", "shard"], "left").na.fill(0, ["blocks", "quota"])
    lines = lines.withColumn("id", F.col("id").cast("string"))  # pandas would make floats of ids beside a null
    taken = lines.groupBy("key", "shard").applyInPandas(_taker(seed), "id string, key string, size long, taken long, copies long").withColumn("id", F.col("id").cast("long"))
    out = taken.join(sources.select("key", "source", "source_size", "target"), "key")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of `docs`, all columns kept, as often as a mix of whole documents takes them.

    Rows that repeat an id share one decision, as do rows with a null id. Documents without words (null, empty, blank)
    occur as often as the block in which they begin; a document of any length is taken whole. Ties between blocks are
    settled by the seed; reruns agree. An empty table gives no rows. Columns may have any names.
    """
    key, times = unused("mix_id", docs), unused("mix_times", docs)
    m = mixture(docs, id_col, text_col, source_col, **options).groupBy(F.col(id_col).alias(key)).agg(F.min("copies").alias(times))
    taken = docs.join(m, F.col(id_col).cast("long").eqNullSafe(F.col(key))).filter(F.col(times) > 0)
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop(key, times)
