"""URL filters: rules by host and path, and trust that spreads over the link graph of hosts for what no rule fits. Native.

1. Rules. A rule fits its host, that host's subdomains, and paths that begin with its own; the longest rule decides. Hosts
   are looked up by their suffixes, paths by prefixes of the lengths that the suffix's rules have: equal keys alone.
2. Seeds. A page that a rule allows gives its host one unit of trust, one that a rule blocks a unit of distrust.
3. Propagation. Personalised PageRank from the trusted seeds along links, and from the blocked seeds against them: each
   round passes on `damping` per cent of what came in the round before, by the number of linking pages. Masses are
   whole numbers (millionths of a page), so reruns and other partitionings give the same ones.
4. Threshold. A host with more than `percent` per cent of distrust in its mass is blocked, any other is allowed.

Everything is joined on written tables, so that AQE can split a host that a third of all pages or links have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

# The rules of the query (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UNIT, ROUNDS, DAMPING, PERCENT = 10**6, 20, 85, 50
#: References that name a host: a scheme is optional, what follows the host is left out.
LINK = r"""(?i)[ \t\r\n\f"']href[ \t\r\n\f]*=[ \t\r\n\f]*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"' \t\r\n\f<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host after the first `://` and the path after it, up to `?` or `#`; both empty where there is none."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the longest rule for each place (host, path) that one fits.

    Of rules of equal length that with the longer host decides, then the one that blocks.
    """
    rules = written(rules.filter("host IS NOT NULL AND path IS NOT NULL").distinct(), "url-rules")
    longest = rules.agg(F.max(F.length("host"))).first()[0] or 0
    lengths = rules.groupBy(F.col("host").alias("suffix")).agg(F.collect_set(F.length("path")).alias("lengths"))
    # Suffixes no longer than the longest host of a rule: those that begin after a point, and the host itself.
    labels = F.split(F.right("host", F.lit(longest + 1)), r"\.")
    after = F.transform(F.sequence(F.lit(2), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    suffixes = F.concat(F.when(F.size("labels") > 1, after).otherwise(F.array().cast("array<string>")), F.array("host"))
    hosts = places.select("host").distinct().withColumn("labels", labels).select("host", F.explode(F.array_distinct(suffixes)).alias("suffix"))
    keys = written(hosts.join(lengths, "suffix").groupBy("host").agg(F.collect_list(F.struct("suffix", "lengths")).alias("keys")), "url-hosts")
    tried = places.join(keys, "host").select("host", "path", F.explode("keys").alias("k")).select("host", "path", "k.suffix", F.explode("k.lengths").alias("n")).filter("n <= length(path)")
    tried = tried.withColumn("prefix", F.expr("substring(path, 1, n)"))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), (F.col("verdict") == "block").alias("block"))
    fit = F.struct((F.length("suffix") + F.length("prefix")).alias("n"), F.length("suffix").alias("m"), "block", F.concat("suffix", "prefix").alias("rule"))
    best = tried.join(named, ["suffix", "prefix"]).groupBy("host", "path").agg(F.max(fit).alias("b"))
    return best.select("host", "path", "b.rule", F.when(F.col("b.block"), "block").otherwise("allow").alias("verdict"))


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): how many pages of host src refer to the other host dst. References within a host are none."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1), lower_ascii))
    links = pages.select(host_and_path(F.col(url_col))[0].alias("src"), F.explode(found).alias("dst"))
    return links.filter("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """(host, trust, distrust) long, of all hosts that any mass reaches; seeds are (host, trust, distrust).

    Links (src, dst, n) pass trust on from src to dst and distrust from dst to src, by n's share of all that the passing
    host has in that direction; a host without any passes nothing on. What rounds down to 0 goes no further.
    """
    ways = links.select(F.lit(0).alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "n").union(links.select(F.lit(1), "dst", "src", "n"))
    ways = written(ways, "url-ways")
    totals = written(ways.groupBy("kind", "at").agg(F.sum("n").alias("total")), "url-totals")
    ways = written(ways.join(totals, ["kind", "at"]), "url-ways")
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trust").alias("mass")), F.struct(F.lit(1).alias("kind"), F.col("distrust").alias("mass"))))
    came = written(seeds.select("host", both.alias("s")).select("s.kind", F.col("host").alias("at"), "s.mass").filter("mass > 0"), "url-mass")
    masses = came
    share = F.expr(f"CAST(mass AS DECIMAL(19, 0)) * CAST({damping} * n AS DECIMAL(18, 0)) div CAST(100 * total AS DECIMAL(19, 0))")
    for _ in range(rounds):
        passed = came.join(ways, ["kind", "at"]).select("kind", F.col("to").alias("at"), share.alias("mass"))
        came = written(passed.groupBy("kind", "at").agg(F.sum("mass").alias("mass")).filter("mass > 0"), "url-mass")
        if came.isEmpty():
            break
        masses = masses.union(came)
    mass = lambda k, name: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)).alias(name)
    return masses.groupBy(F.col("at").alias("host")).agg(mass(0, "trust"), mass(1, "distrust"))


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rounds: int = ROUNDS, damping: int = DAMPING, percent: int = PERCENT) -> DataFrame:
    """Return (page id, host, path, rule, verdict, trust, distrust), one row per input row.

    rules are (verdict allow or block, host, path). rule is the longest one that fits, or null; then the verdict is that of
    the host. trust and distrust are the host's masses in millionths of a page. A host that no mass reaches is allowed, and
    so is an url that is null or has no `://` (its host and path are empty). A null html refers to nothing. Texts of any
    length are read whole; repeated rows count as often as they occur, and each gets its row; a null id makes no difference.
    Without rules all is allowed. Empty tables give no rows; other columns are ignored, whatever their names.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    places = written(rows.groupBy("host", "path").agg(F.count("*").alias("pages")), "url-places")
    fits = fitting_rules(places.select("host", "path"), rules)
    ruled = written(places.join(fits, ["host", "path"], "left"), "url-ruled")
    unit = lambda verdict, name: F.coalesce(F.sum(F.when(F.col("verdict") == verdict, F.col("pages"))) * UNIT, F.lit(0)).alias(name)
    seeds = ruled.filter("verdict IS NOT NULL AND host <> ''").groupBy("host").agg(unit("allow", "trust"), unit("block", "distrust"))
    hosts = written(propagated(seeds, host_links(pages, url_col, html_col), rounds, damping), "url-scores")
    judged = ruled.join(hosts, "host", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("trust", "distrust")})
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    bad = wide("distrust") * (100 - percent) > wide("trust") * percent
    verdict = F.coalesce("verdict", F.when(bad, "block").otherwise("allow"))
    judged = written(judged.select("host", "path", "rule", verdict.alias("verdict"), "trust", "distrust"), "url-judged")
    return rows.join(judged, ["host", "path"]).select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "trust", "distrust")


def rule_table(spark, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")
