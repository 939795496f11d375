"""Column functions: time codes, dates, addresses, texts, paths, urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of action kinds.
ACT_CODES = {"logon": 1, "logoff": 2, "connect": 3, "disconnect": 4, "http": 5, "email": 6, "file": 7}
WORK_START, WORK_END = 7 * 3600 + 1800, 17 * 3600 + 1800


# --- actions and time ------------------------------------------------------------------------------------------


def act_code(activity: Column, source: Column) -> Column:
    """The code of an action: of its activity if that is a log-on or device event, else of its source."""
    kind = F.lower(F.trim(activity))
    kind = F.when(kind.isin("logon", "logoff", "connect", "disconnect"), kind).otherwise(F.lower(source))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ACT_CODES.items() for x in pair]), kind)


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def is_after_hours(ts: Column) -> Column:
    """Before 07:30:00 or after 17:30:00; both bounds are work time."""
    return (second_of_day(ts) < WORK_START) | (second_of_day(ts) > WORK_END)


def is_weekend(ts: Column) -> Column:
    return F.dayofweek(ts).isin(1, 7)


def time_code(ts: Column) -> Column:
    """1 weekday in work hours, 2 weekday after hours, 3 weekend in work hours, 4 weekend after hours."""
    return F.when(is_weekend(ts), F.when(is_after_hours(ts), 4).otherwise(3)).otherwise(F.when(is_after_hours(ts), 2).otherwise(1))


def day_number(ts: Column, monday: str) -> Column:
    return F.datediff(F.to_date(ts), F.lit(monday).cast("date"))


def week_number(ts: Column, start: str) -> Column:
    return F.floor(F.datediff(F.to_date(ts), F.lit(start).cast("date")) / 7).cast("int")


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def from_day_number(n: Column, monday: str) -> Column:
    return F.date_add(F.lit(monday).cast("date"), n)


def week_of_year(ts: Column) -> Column:
    """Weeks begin on Monday; the days before the year's first Monday are week 0."""
    return F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("int")


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd/yyyy HH:mm:ss")


# --- texts and addresses ---------------------------------------------------------------------------------------


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def word_count(text: Column) -> Column:
    """Spaces plus one."""
    return count_of(text, " ") + 1


def addresses(text: Column, sep: str = ";", legacy: bool = False) -> Column:
    """A list of addresses; empty parts are dropped unless `legacy` (an empty text then is one empty address)."""
    parts = F.split(F.coalesce(text, F.lit("")), sep)
    return parts if legacy else F.filter(parts, lambda x: x != "")


def email_counts(to: Column, cc: Column, bcc: Column, domain: str) -> dict[str, Column]:
    """n_des, n_bccdes, n_exdes, Xemail, exbccmail from lists of addresses; outside is what lacks `domain`."""
    outside = lambda xs: F.filter(xs, lambda x: ~x.contains(domain))
    n_out = F.size(outside(F.concat(to, cc, bcc)))
    return {
        "n_des": F.size(to) + F.size(cc) + F.size(bcc),
        "n_bccdes": F.size(bcc),
        "n_exdes": n_out,
        "Xemail": (n_out > 0).cast("int"),
        "exbccmail": (F.size(outside(bcc)) > 0).cast("int"),
    }


def mail_direction(activity: Column) -> dict[str, Column]:
    return {"send_mail": (activity == "Send").cast("int"), "receive_mail": activity.isin("Receive", "View").cast("int")}


# --- files -----------------------------------------------------------------------------------------------------

# File extensions by type.
FILE_TYPES = {2: ["zip", "rar", "7z"], 3: ["jpg", "png", "bmp"], 4: ["doc", "docx", "pdf"], 5: ["txt", "cfg", "rtf"], 6: ["exe", "sh"]}
FILE_TYPE_NAMES = ["other", "comp", "pho", "doc", "txt", "exe"]
FILE_ACTIONS = {"file open": 1, "file copy": 2, "file write": 3, "file delete": 4}
HTTP_ACTIONS = {"www visit": 1, "www download": 2, "www upload": 3}


def file_type(extension: Column) -> Column:
    """2 archives, 3 pictures, 4 documents, 5 texts, 6 programs, 1 others."""
    out = F.when(F.lit(False), 1)
    for code, names in FILE_TYPES.items():
        out = out.when(extension.isin(names), code)
    return out.otherwise(1)


def extension(path: Column) -> Column:
    """What follows the first point, up to the next; null without a point is type 1."""
    return F.coalesce(F.get(F.split(path, r"\."), F.lit(1)), F.lit(""))


def disk(path: Column) -> Column:
    return F.when(F.substring(path, 1, 1) == "C", 1).when(F.substring(path, 1, 1) == "R", 2).otherwise(0)


def path_depth(path: Column) -> Column:
    return count_of(path, "\\")


def coded(text: Column, codes: dict[str, int]) -> Column:
    """The code of a lower-cased text, 0 if it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), F.lower(text)), F.lit(0))


def attachments(text: Column) -> Column:
    """Array of (type, size) of attachments written name.ext(size), separated by semicolons; others are left out."""
    item = lambda a: F.struct(
        file_type(F.regexp_extract(a, r"\.([^.(]*)\(", 1)).alias("type"), F.regexp_extract(a, r"\((\d+)\)", 1).cast("int").alias("size")
    )
    return F.transform(F.filter(addresses(text), lambda a: a.rlike(r"\.[^.(]*\(\d+\)")), item)


def attachment_features(text: Column) -> dict[str, Column]:
    """n_atts and, for each of the six types, the count e_att_* and the size e_att_s*."""
    items = attachments(text)
    out = {"n_atts": F.size(addresses(text))}

    def of_type(code: int) -> Column:
        return F.filter(items, lambda x: x["type"] == code)

    for code, name in enumerate(FILE_TYPE_NAMES, 1):
        chosen = of_type(code)
        out[f"e_att_{name}"] = F.size(chosen)
        out[f"e_att_s{name}"] = F.aggregate(chosen, F.lit(0), lambda s, x: s + x["size"])
    return out


# --- urls ------------------------------------------------------------------------------------------------------

# Sites by category, and domains whose last two labels don't name a site.
SITES = {
    3: ["dropbox.com", "drive.google.com", "mega.co.nz", "account.live.com"],
    5: ["wikileaks.org", "freedom.press", "theintercept.com"],
    2: ["facebook.com", "twitter.com", "plus.google.com", "instagr.am", "instagram.com", "flickr.com", "linkedin.com", "reddit.com", "about.com", "youtube.com", "pinterest.com", "tumblr.com", "quora.com", "vine.co", "match.com", "t.co"],
    4: ["indeed.com", "monster.com", "careerbuilder.com", "simplyhired.com"],
}
SPY_SITES = ["webwatchernow.com", "actionalert.com", "relytec.com", "refog.com", "wellresearchedreviews.com", "softactivity.com", "spectorsoft.com", "best-spy-soft.com"]
LONG_DOMAINS = ["google.com", ".co.uk", ".co.nz", "live.com"]


def url_depth(url: Column) -> Column:
    return count_of(url, "/") - 2


def domain(url: Column) -> Column:
    """The host; of more than two labels the last two, unless it is under one of LONG_DOMAINS."""
    host = F.regexp_extract(url, "//(.*?)/", 1)
    labels = F.split(host, r"\.")
    long = host.contains(LONG_DOMAINS[0])
    for x in LONG_DOMAINS[1:]:
        long = long | host.contains(x)
    return F.when((F.size(labels) > 2) & ~long, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)


def url_category(url: Column, name: Column, sites: dict[int, list[str]] | None = None, spy_sites: list[str] | None = None) -> Column:
    """1 other, 2 social, 3 cloud, 4 jobs, 5 leaks, 6 hacking; the first rule that holds decides."""
    sites, spy_sites = sites or SITES, spy_sites or SPY_SITES
    out = F.when(F.lit(False), 1)
    for code, names in sites.items():
        out = out.when(name.isin(names), code)
    hunt = name.contains("job") & (name.contains("hunt") | name.contains("search"))
    portal = name.contains("aol.com") & (url.contains("recruit") | url.contains("job"))
    return out.when(hunt | portal, 4).when(name.isin(spy_sites) | name.contains("keylog"), 6).otherwise(1)


# --- numbers ---------------------------------------------------------------------------------------------------


def model_input(c: Column) -> Column:
    """log(1 + x) of what is above 0, as a float; what isn't a number counts as 0."""
    return F.log1p(F.greatest(F.coalesce(c.cast("string").try_cast("float"), F.lit(0.0).cast("float")), F.lit(0.0).cast("float")))


def z_score(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / (std + 1e-6)
