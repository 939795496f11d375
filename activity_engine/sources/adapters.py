"""Views that give the given tables the shape of the activity data, with the same derivation in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import time_code
from ..operators.actions import usb_duration
from ..operators.users import attributes
from ..schemas import log_schema

FIRST_MONDAY, FIRST_SUNDAY = "2024-01-01", "2023-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as user actions: actid, user, ts, value, k, pcid, act, subtype, day, week."""
    return acts_of(table(spark, sf_dir, "events"))


def acts_of(e: DataFrame) -> DataFrame:
    """Rows of the form of `events`, also as they stream in, as `acts`."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select(F.col("event_id").alias("actid"), F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", k.alias("k"))
    owner = F.when(F.col("k") % 10 < 6, F.col("user")).when(F.col("k") % 10 < 8, (F.col("user") + 1) % 15).otherwise(F.col("k") % 15)
    act = (
        F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 2)
        .when(F.col("event_type") == "purchase", F.when(F.col("k") % 2 == 0, 3).otherwise(4))
        .when(F.col("event_type") == "click", 5).otherwise(F.when(F.col("k") % 2 == 0, 6).otherwise(7))
    )
    day = lambda start: F.datediff(F.to_date("ts"), F.lit(start).cast("date"))
    return e.select(
        "actid", "user", "ts", "value", "k", F.concat(F.lit("PC-"), owner.cast("string")).alias("pcid"), act.alias("act"), (1 + F.col("k") % 6).alias("subtype"),
        day(FIRST_MONDAY).alias("day"), F.floor(day(FIRST_SUNDAY) / 7).cast("int").alias("week"),
    )


ACTS_SQL = """acts AS (
 SELECT actid, "user", ts, value, k,
  'PC-' || CAST(CASE WHEN k % 10 < 6 THEN "user" WHEN k % 10 < 8 THEN ("user" + 1) % 15 ELSE k % 15 END AS VARCHAR) AS pcid,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 3 ELSE 4 END
   WHEN 'click' THEN 5 ELSE CASE WHEN k % 2 = 0 THEN 6 ELSE 7 END END AS act,
  1 + k % 6 AS subtype, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS day,
  CAST(date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) // 7 AS INT) AS week
 FROM (SELECT event_id AS actid, user_id AS "user", ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e)"""

#: Numeric features of an action, each a function of the event's number k.
STATS = {
    "file_len": "10 * k + subtype", "file_depth": "k % 5", "file_nwords": "k % 17", "disk": "k % 3", "url_len": "20 + k", "url_depth": "k % 4",
    "http_c_len": "3 * k", "http_c_nwords": "k % 23", "n_des": "1 + k % 3", "n_atts": "k % 2", "n_exdes": "k % 2", "n_bccdes": "(k % 5 - k % 5 % 4) / 4",
    "email_size": "7 * k", "email_text_slen": "5 * k", "email_text_nwords": "1 + k % 29", "Xemail": "k % 2", "exbccmail": "(k % 5 - k % 5 % 4) / 4", "pc": "k % 4",
}


def org_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`customer` as users with organisation and psychometric scores."""
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    scores = [(k % n).cast("int").alias(c) for c, n in zip("OCEAN", (50, 43, 37, 31, 29), strict=True)]
    org = [F.col("c_mktsegment").alias("role"), text(F.col("c_nationkey")).alias("b_unit"), text(k % 4).alias("f_unit"), text(k % 11).alias("dept"), text(k % 17).alias("team")]
    return attributes(table(spark, sf_dir, "customer").select(k.alias("user"), *org, *scores), admin="MACHINERY")


ORG_SQL = """org AS (SELECT c_custkey AS "user", """ + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INT) AS {n}"
    for n, c in (("role", "c_mktsegment"), ("b_unit", "CAST(c_nationkey AS VARCHAR)"), ("f_unit", "CAST(c_custkey % 4 AS VARCHAR)"), ("dept", "CAST(c_custkey % 11 AS VARCHAR)"), ("team", "CAST(c_custkey % 17 AS VARCHAR)"))
) + """, CAST(c_mktsegment = 'MACHINERY' AS INT) AS "ITAdmin", """ + ", ".join(f'CAST(c_custkey % {n} AS INT) AS "{c}"' for c, n in zip("OCEAN", (50, 43, 37, 31, 29), strict=True)) + " FROM customer)"


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric action rows: `acts` with time code, pc code, usb duration, statistics and labels."""
    a = usb_duration(acts(spark, sf_dir).withColumn("time", time_code(F.col("ts"))), ["week", "user", "pcid"])
    a = a.select("*", *[F.expr(f"CAST({e} AS INT)").alias(n) for n, e in STATS.items()])
    a = a.withColumns({"file_type": F.col("subtype"), "http_type": F.col("subtype")})
    insider = F.when(F.col("user") % 14 == 0, 1).otherwise(0)
    return a.withColumns({"insider": insider, "mal_act": F.when((F.col("value") > 60) & (insider == 1), 1).otherwise(0)})


ACTIONS_SQL = (
    ACTS_SQL
    + """, coded AS (
 SELECT *, CASE WHEN isodow(ts) < 6 THEN CASE WHEN CAST(ts AS TIME) < TIME '07:30:00' OR CAST(ts AS TIME) >= TIME '17:30:01' THEN 2 ELSE 1 END
  ELSE CASE WHEN CAST(ts AS TIME) < TIME '07:30:00' OR CAST(ts AS TIME) >= TIME '17:30:01' THEN 4 ELSE 3 END END AS time FROM acts),
 usb AS (SELECT actid, CASE WHEN nact = 4 AND act = 3 THEN CAST(epoch(date_trunc('second', nts)) - epoch(date_trunc('second', ts)) AS INT) ELSE -1 END AS usb_dur FROM (
  SELECT actid, act, ts, lead(act) OVER w AS nact, lead(ts) OVER w AS nts FROM acts WHERE act IN (3, 4)
  WINDOW w AS (PARTITION BY week, "user", pcid ORDER BY ts, actid)) x),
 actions AS (SELECT c.*, CASE WHEN c.act = 3 THEN usb_dur ELSE 0 END AS usb_dur, """
    + ", ".join(f"CAST({e} AS INT) AS {n}" for n, e in STATS.items())
    + """, subtype AS file_type, subtype AS http_type, CASE WHEN "user" % 14 = 0 THEN 1 ELSE 0 END AS insider,
  CASE WHEN value > 60 AND "user" % 14 = 0 THEN 1 ELSE 0 END AS mal_act FROM coded c LEFT JOIN usb USING (actid))"""
)


# Raw logs: what each file holds of an action, as SQL over `acts`; contents are functions of the event's number k.
HOSTS = ["www.dropbox.com", "example.org", "wikileaks.org", "m.facebook.com"]
EXTENSIONS = ["log", "zip", "jpg", "doc", "txt", "exe"]
_WORDS = "repeat('ab ', k % 23) || 'z'"
_PICK = "element_at(array({}), {} + 1)"


def _pick(values: list[str], n: str) -> str:
    return _PICK.format(", ".join(f"'{v}'" for v in values), n)


RAW = {
    "logon": ("act IN (1, 2)", {"activity": _pick(["Logon", "Logoff"], "act - 1")}),
    "device": ("act IN (3, 4)", {"content": "CASE WHEN act = 3 THEN repeat('R:/x;', k % 3) || 'R:/x' END", "activity": _pick(["Connect", "Disconnect"], "act - 3")}),
    "http": ("act = 5", {"url": f"'http://' || {_pick(HOSTS, 'k % 4')} || '/' || repeat('d/', k % 5)", "activity": _pick(["WWW Visit", "WWW Download", "WWW Upload"], "k % 3"), "content": _WORDS}),
    "email": ("act = 6", {
        "to": "repeat('a@dtaa.com;', k % 3) || 'b@x.com'", "bcc": "CASE WHEN k % 2 = 1 THEN 'c@y.org' END", "from": "'u@dtaa.com'", "activity": _pick(["Send", "Receive", "View"], "k % 3"),
        "size": "7 * k", "n_att": "k % 4", "att": "repeat('f.doc(10);', k % 3) || 'g.exe(5)'", "content": _WORDS,
    }),
    "file": ("act = 7", {
        "filename": f"{_pick(['C', 'R', 'D'], 'k % 3')} || ':' || chr(92) || repeat('d' || chr(92), k % 5) || 'f.' || {_pick(EXTENSIONS, 'k % 6')}",
        "activity": _pick(["File Open", "File Copy", "File Write", "File Delete"], "k % 4"), "to": _pick(["False", "True"], "k % 2"), "from": "CASE WHEN k % 3 = 0 THEN 'True' ELSE 'False' END", "content": _WORDS,
    }),
}


def write_raw_logs(acts: DataFrame, folder: str, version: str) -> None:
    """The five log files of a dataset version, from the rows of `acts`."""
    for kind, (rows, values) in RAW.items():
        base = {"id": "concat('{', actid, '}')", "date": "date_format(ts, 'MM/dd/yyyy HH:mm:ss')", "user": "concat('U', user)", "pc": "pcid"} | values
        fields = log_schema(version, kind).fields
        columns = [F.expr(base.get(f.name, "CAST(NULL AS STRING)")).cast(f.dataType).alias(f.name) for f in fields]
        acts.filter(rows).select(*columns).write.csv(f"{folder}/{kind}.csv", header=True, quote='"', escape='"')


_W = "CAST(k % 23 AS INT)"
#: What the features of a raw action are, by formulas of their own: (act, SQL).
RAW_FEATURES = {
    "file_tree_len": (3, "k % 3 + 1"), "file_type": (7, "k % 6 + 1"), "file_len": (7, f"3 * {_W} + 1"), "file_nwords": (7, f"{_W} + 1"), "disk": (7, "[1, 2, 0][k % 3 + 1]"), "file_depth": (7, "k % 5 + 1"),
    "file_act": (7, "k % 4 + 1"), "to_usb": (7, "k % 2"), "from_usb": (7, "CAST(k % 3 = 0 AS INT)"), "http_type": (5, "[3, 1, 5, 2][k % 4 + 1]"),
    "url_len": (5, f"8 + [{', '.join(str(len(h)) for h in HOSTS)}][k % 4 + 1] + 2 * (k % 5)"), "url_depth": (5, "k % 5 + 1"), "http_c_len": (5, f"3 * {_W} + 1"), "http_c_nwords": (5, f"{_W} + 1"), "http_act": (5, "k % 3 + 1"),
    "send_mail": (6, "CAST(k % 3 = 0 AS INT)"), "receive_mail": (6, "CAST(k % 3 > 0 AS INT)"), "n_des": (6, "k % 3 + 1 + k % 2"), "n_atts": (6, "k % 3 + 1"), "Xemail": (6, "1"), "n_exdes": (6, "1 + k % 2"),
    "n_bccdes": (6, "k % 2"), "exbccmail": (6, "k % 2"), "email_size": (6, "7 * k"), "email_text_slen": (6, f"3 * {_W} + 1"), "email_text_nwords": (6, f"{_W} + 1"),
    **{f"e_att_{n}": (6, {"doc": "k % 3", "exe": "1"}.get(n, "0")) for n in ("other", "comp", "pho", "doc", "txt", "exe")},
    **{f"e_att_s{n}": (6, {"doc": "10 * (k % 3)", "exe": "5"}.get(n, "0")) for n in ("other", "comp", "pho", "doc", "txt", "exe")},
}
