"""From raw activity logs to numeric action rows: the way into the feature tables for each dataset version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .actions import label_actions, pc_codes, usb_duration

# Fixed value: the mail domain of the organisation.
DOMAIN = "dtaa.com"


def _newer(version: str) -> bool:
    return version[1] in "56"


def _columns(activity: DataFrame, version: str) -> dict[str, tuple[int, Column]]:
    """{feature: (act, value)}: the features of each kind of action; they are 0 for all others."""
    text = F.coalesce("content", F.lit(""))
    size, words = F.length(text), S.word_count(text)
    path, url, kind = F.col("filename"), F.col("url"), F.col("activity") if "activity" in activity.columns else F.lit(None).cast("string")
    true = lambda c: (F.lower(F.trim(c)) == "true").cast("int")
    out: dict[str, tuple[int, Column]] = {}
    if _newer(version):
        out["file_tree_len"] = (3, F.size(F.split(text, ";")))
    out |= {
        "file_type": (7, S.file_type(S.extension(path))), "file_len": (7, size), "file_nwords": (7, words), "disk": (7, S.disk(path)), "file_depth": (7, S.path_depth(path)),
    }
    if _newer(version):
        out |= {"file_act": (7, S.coded(kind, S.FILE_ACTIONS)), "to_usb": (7, true("to")), "from_usb": (7, true("from"))}
    out |= {"http_type": (5, S.url_category(url, S.domain(url))), "url_len": (5, F.length(url)), "url_depth": (5, S.url_depth(url)), "http_c_len": (5, size), "http_c_nwords": (5, words)}
    if version[1] == "6":
        out["http_act"] = (5, S.coded(kind, S.HTTP_ACTIONS))
    if _newer(version):
        out |= {n: (6, c) for n, c in S.mail_direction(kind).items()}
    mail = S.email_counts(S.addresses(F.col("to")), S.addresses(F.col("cc")), S.addresses(F.col("bcc")), DOMAIN)
    files = S.attachment_features(F.col("att")) if _newer(version) else {"n_atts": F.col("n_att")}
    out |= {"n_des": (6, mail["n_des"]), "n_atts": (6, files.pop("n_atts"))}
    out |= {n: (6, mail[n]) for n in ("Xemail", "n_exdes", "n_bccdes", "exbccmail")}
    out |= {"email_size": (6, F.col("size")), "email_text_slen": (6, size), "email_text_nwords": (6, words)}
    return out | {n: (6, c) for n, c in files.items()}


def numeric_actions(activity: DataFrame, users: DataFrame, insiders: DataFrame, answers: DataFrame, version: str, first_sunday: str, first_monday: str) -> DataFrame:
    """The numeric actions of `read_activity`'s rows: actid, pcid, ts, user, day, week, act, pc, time, features, mal_act, insider.

    `users`: user, pc, sharedpc, sup; `insiders` and `answers` as their readers give them. Features are whole numbers,
    0 where an action is of another kind; what can't be read (a size, a null text) counts as 0 or empty. Rows whose
    time can't be read are left out. Users that aren't in `users` use others' computers (2).
    """
    a = activity.filter("ts IS NOT NULL").withColumnsRenamed({"id": "actid", "pc": "pcid"})
    kind = F.col("activity") if "activity" in a.columns else F.lit(None).cast("string")
    source = F.col("type")
    # Mail and file activities have names of their own: only log-on and device events are told by them.
    a = a.withColumns({"act": S.act_code(kind, source), "day": S.day_number(F.col("ts"), first_monday), "week": S.week_number(F.col("ts"), first_sunday), "time": S.time_code(F.col("ts"))})
    features = {n: F.when(F.col("act") == act, F.coalesce(c.cast("int"), F.lit(0))).otherwise(0).alias(n) for n, (act, c) in _columns(a, version).items()}
    a = a.select("actid", "pcid", "ts", "user", "day", "week", "act", "time", *features.values())
    a = usb_duration(a, ["week", "user", "pcid"])
    a = label_actions(pc_codes(a, users).withColumnRenamed("pc_code", "pc"), insiders, answers)
    return a.select("actid", "pcid", "ts", "user", "day", "week", "act", "pc", "time", "usb_dur", *features, "mal_act", "insider")
