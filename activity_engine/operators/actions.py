"""Numeric action rows: device durations, computer codes, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usb_duration(acts: DataFrame, by: list[str], act: str = "act", ts: str = "ts", order: str = "actid", connect: int = 3, disconnect: int = 4, legacy: bool = False) -> DataFrame:
    """`acts` with `usb_dur`: seconds from a connect to the next device event of `by` if that is a disconnect, else -1.

    Other actions have 0. `legacy` gives the rule that looks at the connect itself: always -1, 0 at equal times.
    """
    device = F.col(act).isin(connect, disconnect)
    # Other actions form groups of their own, by id: they need no order, and a hot computer's rows spread out.
    w = Window.partitionBy(*by, F.when(~device, F.col(order))).orderBy(ts, order)
    after = F.lead(F.struct(act, ts)).over(w)
    seconds = (F.unix_timestamp(after[ts]) - F.unix_timestamp(ts)).cast("int")
    paired = after[act] == disconnect
    hit = F.coalesce(paired & (seconds == 0), F.lit(False)) if legacy else F.coalesce(paired, F.lit(False))
    return acts.withColumn("usb_dur", F.when(F.col(act) == connect, F.when(hit, seconds).otherwise(-1)).otherwise(0))


def pc_codes(acts: DataFrame, users: DataFrame, user: str = "user", pc: str = "pcid") -> DataFrame:
    """`acts` with `pc_code`: 0 own, 1 shared, 3 the supervisor's, 2 any other. `users`: user, pc, sharedpc, sup."""
    u = users.select(F.col(user).alias("_u"), F.col("pc").alias("_own"), F.col("sharedpc").alias("_shared"), F.col("sup").alias("_sup"))
    bosses = users.select(F.col(user).alias("_b"), F.col("pc").alias("_boss_pc"))
    known = u.join(bosses, F.col("_sup") == F.col("_b"), "left").drop("_b", "_sup")
    code = (
        F.when(F.col(pc) == F.col("_own"), 0)
        .when(F.array_contains("_shared", F.col(pc)), 1)
        .when(F.col(pc) == F.col("_boss_pc"), 3)
        .otherwise(2)
    )
    known = known.hint("shuffle_hash")  # wide rows of actions pass by unsorted; a task holds its users alone
    return acts.join(known, F.col(user) == F.col("_u"), "left").withColumn("pc_code", code).drop("_u", "_own", "_shared", "_boss_pc")


def insider_index(index: DataFrame, user: str = "user", order: str = "mstart") -> DataFrame:
    """One row a user of the insider index; the last row wins."""
    w = Window.partitionBy(user).orderBy(F.desc(order), F.desc("scenario"))
    return index.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def label_actions(acts: DataFrame, insiders: DataFrame, answers: DataFrame, user: str = "user", actid: str = "actid", week: str = "week", ts: str = "ts") -> DataFrame:
    """`acts` with `mal_act` and `insider` (the scenario), set where two things hold.

    The dates of the action's week overlap the user's scenario [mstart, mend], and (user, actid) is an answer.
    """
    weeks = acts.groupBy(week).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))  # a row a week: sent to the rows, which keep their places
    index = insider_index(insiders, user).select(user, "scenario", "mstart", "mend")
    hit = answers.select(user, actid).distinct().join(index, user)
    out = acts.join(F.broadcast(weeks), week).join(hit.hint("shuffle_hash"), [user, actid], "left")  # hashed: rows pass by unsorted
    bad = F.coalesce((F.col("_lo") <= F.col("mend")) & (F.col("mstart") <= F.col("_hi")), F.lit(False))
    out = out.withColumns({"mal_act": bad.cast("int"), "insider": F.when(bad, F.col("scenario")).otherwise(0)})
    return out.drop("_lo", "_hi", "scenario", "mstart", "mend")
