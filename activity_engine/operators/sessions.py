"""Sessions of a user on a computer in a week, and their sub-sessions.

A logon opens a session (start 1); any other first action opens one too (start 2). A logoff ends it (end 1), a logon
ends the one before it (end 2). Sessions that are still open at the end of the week are left out. All in windows; no
session is gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .features import feature_table, features, group_label, label


def session_id(week, nth):
    """week * 100000 + nth for the first 100,000 sessions of a week; the next 100,000 are that and 10**12, and so on.

    Ids of different sessions differ, as long as weeks are below 10**7.
    """
    return F.floor(nth / 100000) * 10**12 + week.cast("long") * 100000 + nth % 100000


def running_id(week, nth):
    """week * 100000 + nth, whatever nth is: unique in a week; from 100,000 sessions in a week on, the next week's ids come again."""
    return week.cast("long") * 100000 + nth


def sessionize(
    acts: DataFrame, user: str = "user", week: str = "week", pc: str = "pcid", ts: str = "ts", order: str = "actid", act: str = "act", ids: Callable[[Column, Column], Column] = session_id
) -> DataFrame:
    """`acts` (rows of complete sessions) with session_id (`ids` of week and number), start_with, end_with, n_concurrent.

    Two windows by (user, week[, pc]): closes are odd places in a run of logoffs (even ones if nothing precedes the
    run), an action opens a session if it is the first, a logon, or follows a close. A session that opens while
    others are open counts 2, and every later opening of the user's week adds 1.
    """
    uw = Window.partitionBy(user, week).orderBy(ts, order)
    on_pc = Window.partitionBy(user, week, pc).orderBy("_r")
    a = acts.withColumn("_r", F.row_number().over(uw)).withColumn("_i", F.row_number().over(on_pc))
    off = F.col(act) == 2
    a = a.withColumn("_other", F.max(F.when(~off, F.col("_i"))).over(on_pc)).withColumn("_pos", F.col("_i") - F.coalesce("_other", F.lit(0)))
    a = a.withColumn("_closes", off & (F.col("_pos") % 2 == F.when(F.col("_other").isNotNull(), 1).otherwise(0)))
    a = a.withColumn("_opens", (F.col("_i") == 1) | (F.col(act) == 1) | F.coalesce(F.lag("_closes").over(on_pc), F.lit(False)))
    a = a.withColumn("_sid", F.sum(F.col("_opens").cast("int")).over(on_pc))

    # A session ends where a row closes it, or where the next one on the computer opens.
    a = a.withColumn("_cut", F.col("_opens") & (F.col("_i") > 1) & ~F.lag("_closes", 1, False).over(on_pc))
    running = Window.partitionBy(user, week).orderBy("_r")
    a = a.withColumn("_o", F.sum(F.col("_opens").cast("int")).over(running)).withColumn("_c", F.sum((F.col("_closes").cast("int") + F.col("_cut").cast("int"))).over(running))
    whole = Window.partitionBy(user, week, pc, "_sid")
    after = Window.partitionBy(user, week, pc).orderBy("_r")
    a = a.withColumn("_next", F.struct(F.lead("_cut").over(after).alias("cut"), F.lead("_r").over(after).alias("r"), F.lead("_o").over(after).alias("o")))
    end = F.when(F.col("_closes"), F.struct(F.lit(1).alias("w"), F.col("_r").alias("r"), F.col("_o").alias("o"))).when(
        F.col("_next.cut"), F.struct(F.lit(2).alias("w"), F.col("_next.r").alias("r"), (F.col("_next.o") - 1).alias("o"))
    )
    a = a.withColumn("_end", F.max(end).over(whole))
    start = F.max(F.when(F.col("_opens"), F.struct(F.when(F.col(act) == 1, 1).otherwise(2).alias("w"), F.col("_o").alias("o"), (F.col("_o") - F.col("_c") - 1).alias("others")))).over(whole)
    a = a.withColumn("_start", start).filter("_end IS NOT NULL")
    concurrent = 1 + (F.col("_start.others") > 0).cast("int") + F.col("_end.o") - F.col("_start.o")

    # Numbers run through a week by user: each user's sessions are numbered by where they end, and the users' counts summed.
    a = a.withColumn("_nth", F.dense_rank().over(Window.partitionBy(user, week).orderBy(F.col("_end.r"), pc)) - 1)
    counts = a.groupBy(user, week).agg((F.max("_nth") + 1).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(week).orderBy(user).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(user, week, F.coalesce(before, F.lit(0)).alias("_before"))
    a = a.withColumns({"start_with": F.col("_start.w"), "end_with": F.col("_end.w"), "n_concurrent": concurrent.cast("int")})
    a = a.join(counts, [user, week]).withColumn("session_id", ids(F.col(week), F.col("_before") + F.col("_nth")))
    return a.drop("_nth", "_before", "_r", "_i", "_other", "_pos", "_closes", "_opens", "_cut", "_o", "_c", "_next", "_end", "_start", "_sid")


def session_table(rows: DataFrame) -> DataFrame:
    """One row a session, from the rows of `sessionize`."""
    return rows.groupBy("session_id", "user", "week", "pcid", "start_with", "end_with", "n_concurrent").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_acts"))


def by_time(rows: DataFrame, minutes: int, session: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Rows with `chunk`, of `minutes` each; n_chunks is the length in chunks, rounded up, of what `session` names.

    A session of no length has no chunks and no rows; of several chunks, an action exactly on the last edge is lost.
    """
    s = Window.partitionBy(*session)
    seconds = F.unix_timestamp("ts") - F.unix_timestamp(F.min("ts").over(s))
    total = F.unix_timestamp(F.max("ts").over(s)) - F.unix_timestamp(F.min("ts").over(s))
    out = rows.withColumn("n_chunks", F.ceil(total / (60 * minutes)).cast("int"))
    out = out.withColumn("chunk", F.when(F.col("n_chunks") == 1, 0).otherwise(F.floor(seconds / (60 * minutes))).cast("int"))
    return _ends(out.filter("n_chunks > 0 AND chunk < n_chunks"))


def by_count(rows: DataFrame, n: int) -> DataFrame:
    """Rows with `chunk`, of n actions each."""
    s = Window.partitionBy("session_id")
    out = rows.withColumn("n_chunks", F.ceil(F.count("*").over(s) / n).cast("int"))
    return _ends(out.withColumn("chunk", F.floor((F.row_number().over(s.orderBy("ts", "actid")) - 1) / n).cast("int")))


def _ends(rows: DataFrame) -> DataFrame:
    """Only the last chunk ends as its session does; others end with 0."""
    return rows.withColumn("end_with", F.when(F.col("chunk") < F.col("n_chunks") - 1, 0).otherwise(F.col("end_with")))


def session_features(rows: DataFrame, version: str = "r4.2", chunk: bool = False) -> DataFrame:
    """Descriptors, features and label of each session (or of each chunk of one); `rows` are numeric actions of sessions."""
    by = ["session_id", *(["chunk"] if chunk else []), "user", "week", "start_with", "end_with", "n_concurrent"]
    second = lambda c: F.unix_timestamp(c)
    extra = {"starttime": F.min(second("ts")), "endtime": F.max(second("ts")), "_first": F.min(F.struct("ts", "actid", "day", "pc")), "_n": F.sum(F.lit(1))}
    extra |= {f"_t{k}": F.sum((F.col("time") == k).cast("int")) for k in (1, 2, 3, 4)} | label()
    t = feature_table(rows, by, "session", version, None, extra)
    one = ["session_id", *(["chunk"] if chunk else []), "user", "week"]
    t = t.join(rows.groupBy(*one).agg(F.count_distinct("day").alias("n_days")), one)
    share = lambda k, n: (F.col(f"_t{k}") / F.col("_n")).alias(n)
    hour = lambda c, n: (F.hour(F.timestamp_seconds(c)) + F.minute(F.timestamp_seconds(c)) / 60).alias(n)
    info = [
        "starttime", "endtime", "user", F.col("session_id").alias("sessionid"), *(["chunk"] if chunk else []), F.col("_first.day").alias("day"), "week", F.col("_first.pc").alias("pc"),
        share(1, "isworkhour"), share(2, "isafterhour"), share(3, "isweekend"), share(4, "isweekendafterhour"), "n_days",
        ((F.col("endtime") - F.col("starttime")) / 60).alias("duration"), F.col("n_concurrent").alias("n_concurrent_sessions"), "start_with", "end_with",
        hour("starttime", "ses_start"), hour("endtime", "ses_end"),
    ]
    return t.select(*info, *[F.col(f"`{f.name}`") for f in features("session", version)], group_label().alias("insider"))
