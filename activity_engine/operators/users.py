"""The user dimension: employment months, supervisors, own and shared computers, label codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import positions


def employment(snapshots: DataFrame, user: str, month: str, attributes: list[str]) -> DataFrame:
    """One row a user: attributes as first seen, `wstart` the first month, `wend` the first month of absence or null.

    Months are those that occur in the snapshots; a later return doesn't undo `wend`.
    """
    months = snapshots.select(month).distinct().withColumn("_idx", F.dense_rank().over(Window.orderBy(month)))
    last = months.agg(F.max("_idx").alias("_last"))
    named = snapshots.join(F.broadcast(months), month)  # one row a month
    seen = named.select(user, "_idx").distinct()
    follow = F.lead("_idx").over(Window.partitionBy(user).orderBy("_idx"))
    gaps = seen.withColumn("_next", follow).crossJoin(F.broadcast(last)).filter("coalesce(_next, _last + 1) > _idx + 1 OR (_next IS NULL AND _idx < _last)")
    gone = gaps.groupBy(user).agg((F.min("_idx") + 1).alias("_idx")).join(F.broadcast(months.withColumnRenamed(month, "wend")), "_idx").drop("_idx")
    first = snapshots.groupBy(user).agg(F.min_by(F.struct(*attributes), F.struct(month, *attributes)).alias("_a"), F.min(month).alias("wstart"))
    return first.join(gone, user, "left").select(user, *[f"_a.{a}" for a in attributes], "wstart", "wend")


def with_scores(users: DataFrame, scores: DataFrame, on: str) -> DataFrame:
    """Users with their psychometric scores, null where there are none; of several rows of a user the least one counts."""
    rest = [c for c in scores.columns if c != on]
    one = scores.groupBy(on).agg(F.min(F.struct(*rest)).alias("_s")).select(on, "_s.*")
    return users.join(one, on, "left")


def supervisors(users: DataFrame, user: str, name: str, supervisor_name: str) -> DataFrame:
    """Users with `sup`, the id of the first user who has the supervisor's name, or null."""
    named = users.groupBy(F.col(name).alias("_name")).agg(F.min(user).alias("sup"))
    return users.join(named, F.col(supervisor_name) == F.col("_name"), "left").drop("_name")


def candidate_pcs(acts: DataFrame, user: str, pc: str, week: str, first: int, second: int) -> DataFrame:
    """(user, pcs): computers that a user used in both weeks."""
    both = acts.filter(F.col(week) == first).select(user, pc).intersect(acts.filter(F.col(week) == second).select(user, pc))
    return both.groupBy(user).agg(F.array_sort(F.collect_set(pc)).alias("pcs"))


def own_pcs(candidates: DataFrame, roles: DataFrame, user: str, role: str, admin: str) -> DataFrame:
    """(user, pc, sharedpc): the candidate that the fewest users with several candidates share, and the others.

    Ties go to the smallest name; administrators and users with one candidate have no shared list.
    """
    many = candidates.filter(F.size("pcs") > 1).select(user, F.explode("pcs").alias("_pc"))
    shared = many.groupBy("_pc").agg(F.count("*").alias("_n"))
    best = many.join(shared, "_pc").groupBy(user).agg(F.min_by("_pc", F.struct("_n", "_pc")).alias("_best"))
    out = candidates.join(best, user, "left").join(roles.select(user, F.col(role).alias("_role")), user, "left")
    pc = F.coalesce("_best", F.get("pcs", F.lit(0)))
    rest = F.when(F.col("_best").isNotNull() & ~F.col("_role").eqNullSafe(admin), F.array_except("pcs", F.array("_best")))
    return out.select(user, pc.alias("pc"), rest.alias("sharedpc"))


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with {column}_code: the place of the value among the column's sorted distinct values, from 0; null is UNKNOWN.

    For columns of few values (roles, departments): the distinct ones alone are ranked, in one window.
    """
    for c in columns:
        value = F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN"))
        codes = df.select(value.alias("_v")).distinct().withColumn(f"{c}_code", F.dense_rank().over(Window.orderBy("_v")) - 1)
        df = df.withColumn("_v", value).join(codes, "_v").drop("_v")
    return df


#: Columns of a user on the output tables: codes of the organisation (r5 and r6 have a project too), role flag, scores.
ORGANISATION = ["role", "b_unit", "f_unit", "dept", "team"]
ATTRIBUTES = [*ORGANISATION, "ITAdmin", "O", "C", "E", "A", "N"]


def attributes(users: DataFrame, user: str = "user", version: str = "r4.2", admin: str = "ITAdmin") -> DataFrame:
    """(user, codes of the organisation, ITAdmin, O, C, E, A, N): what the output tables carry of a user."""
    names = [ORGANISATION[0], "project", *ORGANISATION[1:]] if version[1] in "56" else ORGANISATION
    flag = F.coalesce(F.col("role") == admin, F.lit(False)).cast("int").alias("ITAdmin")
    coded = label_codes(users.select(user, *names, flag, *"OCEAN"), names)
    return coded.select(user, *[F.col(f"{n}_code").alias(n) for n in names], "ITAdmin", *"OCEAN")


def user_index(users: DataFrame, user: str, start: str) -> DataFrame:
    """`users` with `user_idx`, the place in the list by first month and id, from 0."""
    placed = positions(users.select(start, user).distinct(), [start, user], "user_idx").withColumn("user_idx", F.col("user_idx").cast("int"))
    return users.join(placed, [start, user])
