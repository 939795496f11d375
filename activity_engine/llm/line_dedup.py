"""Line deduplication by a suffix array over line-ID sequences, built by distributed prefix doubling. Native only.

Every line that isn't blank gets a 128-bit ID; a document is a sequence of IDs, and its suffixes begin at its lines.

1. Prefix doubling. Round k names the 2**k lines that begin at each place by the names of its two halves. A place whose
   name is unique can't begin a longer repeat and drops out; rounds go on until no name occurs twice.
2. Intervals. Places with one name are an interval of the suffix array whose longest common prefix is 2**k or more. The
   longest common prefix of each place with any *earlier* one, in (id, place) order, is found from the deepest names
   down: a place moves on by 2**k lines if an earlier place of its interval moves on with it. The first of those that
   move goes on as a ghost, for the others to meet, and stays behind too. Places and ghosts together give the longest
   common prefix with any other place.
3. Runs. A place whose left neighbour's prefix doesn't reach as far begins a maximal run: one that recurs (`line_runs`),
   or one that begins earlier too (`later_runs`).
4. The lines under the maximal runs of `min_lines` lines or more that begin earlier too are deleted.

Documents with equal texts fall together first: one stands for all, the others are copies as a whole. Names that occur
again are written before they are joined: AQE can then split a line that very many documents hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

_SOLID = r"[^\x20\x09-\x0D]"
_PLACE = ["id", "h", "place"]


def _lines(text: str):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _again(places: DataFrame, key: tuple[str, ...] = ("a", "b"), at: tuple[str, ...] = tuple(_PLACE)) -> DataFrame:
    """The names that occur at two places or more; rows are pre-aggregated before the shuffle."""
    ends = places.groupBy(*key).agg(F.min(F.struct(*at)).alias("x"), F.max(F.struct(*at)).alias("y"))
    return written(ends.filter("x <> y").select(*key), "line-names")


def _longer(left: DataFrame, right: DataFrame, step: int) -> DataFrame:
    """Name the lines of `left` at each place together with those of `right` that begin `step` lines later."""
    follow = right.select("id", "h", (F.col("place") - step).alias("place"), F.col("a").alias("c"), F.col("b").alias("d"))
    both = left.join(follow, _PLACE)
    return both.select(*_PLACE, F.xxhash64("a", "b", "c", "d").alias("a"), F.xxhash64("d", "c", "b", "a", F.lit(1)).alias("b"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, h, u): h and u are hashes of the text."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.withColumns({"h": F.xxhash64("text"), "u": F.xxhash64(F.lit(1), "text")})


def _repeated_lines(base: DataFrame, stands: DataFrame) -> DataFrame:
    """(id, h, place, line, a, b): the lines that occur again, of the texts that stand for themselves."""
    numbered = F.transform(_lines("text"), lambda x, i: F.struct(i.alias("line"), x.alias("words")))
    lines = base.select("h", "u", F.posexplode(F.filter(numbered, lambda s: s["words"].rlike(_SOLID))).alias("place", "s"))
    lines = lines.select("h", "u", "place", "s.line", F.xxhash64("s.words").alias("a"), F.xxhash64("s.words", F.lit(1)).alias("b"))
    again = _again(lines, at=("h", "place"))  # copies of a text count as one
    found = lines.join(again, ["a", "b"]).distinct().join(stands.select("h", "u", "id"), ["h", "u"])
    return written(found.select(*_PLACE, "line", "a", "b"), "lines")


def _doubled(names: DataFrame, deepest: int | None = None) -> list[DataFrame]:
    """Names of depth 1, 2, 4, .. that occur again, up to the depth where none does, or `deepest`."""
    levels = [names]
    while deepest is None or 2 ** len(levels) <= deepest:
        pairs = _longer(levels[-1], levels[-1], 2 ** (len(levels) - 1))
        found = written(pairs.join(_again(pairs), ["a", "b"]).select(*_PLACE, "a", "b"), "line-intervals")
        if found.isEmpty():
            break
        levels.append(found)
    return levels


def _common_prefixes(levels: list[DataFrame]) -> DataFrame:
    """(id, h, place, lcp, earlier): how many lines from each place on also begin at another place, at an earlier one."""
    state = later = None
    for k in range(len(levels) - 1, -1, -1):
        names = levels[k]
        if state is not None:
            more = names.select("id", "h", F.col("place").alias("next"), F.col("a").alias("c"), F.col("b").alias("d"))
            tried = state.withColumn("next", F.col("place") + F.col("lcp")).join(more, ["id", "h", "next"], "left").drop("next")
            tried = tried.withColumns({"c": F.when(F.col("d").isNotNull(), F.xxhash64("a", "b", "c", "d")), "d": F.when(F.col("d").isNotNull(), F.xxhash64("d", "c", "b", "a", F.lit(1)))})
            met = tried.filter("c IS NOT NULL").groupBy("c", "d").agg(F.count("*").alias("n"), F.min(F.struct(*_PLACE)).alias("first"))
            met = written(met.filter("n > 1").select("c", "d", "first"), "line-groups")
            own = tried.join(met, ["c", "d"], "left")
            stay = F.struct("lcp", "a", "b", "ghost")
            on = lambda ghost: F.struct((F.col("lcp") + 2**k).alias("lcp"), F.col("c").alias("a"), F.col("d").alias("b"), ghost.alias("ghost"))
            both = F.when(F.col("first").isNull(), F.array(stay)).when(F.col("first") == F.struct(*_PLACE), F.array(stay, on(F.lit(True)))).otherwise(F.array(on(F.col("ghost"))))
            state = own.select(*_PLACE, F.explode(both).alias("s")).select(*_PLACE, "s.*")
        # New are all places but those with an earlier one at a deeper level, which are there already. The first of an
        # interval is a ghost: no earlier place has its name.
        first = written(names.groupBy("a", "b").agg(F.min(F.struct(*_PLACE)).alias("first")), "line-firsts")
        marked = names.join(first, ["a", "b"]).select(*_PLACE, F.lit(2**k).alias("lcp"), "a", "b", (F.col("first") == F.struct(*_PLACE)).alias("ghost"))
        enter = marked if later is None else marked.join(later, _PLACE, "left_anti")
        later = marked.filter("NOT ghost").select(*_PLACE)
        state = enter if state is None else state.union(enter)
        state = written(state, "line-prefixes") if k else state
    return state.groupBy(*_PLACE).agg(F.max("lcp").alias("lcp"), F.coalesce(F.max(F.when(~F.col("ghost"), F.col("lcp"))), F.lit(0)).alias("earlier"))


def _maximal(prefixes: DataFrame, length: str, min_lines: int) -> DataFrame:
    """(id, h, place, n): runs of `min_lines` or more that no run from the place before reaches beyond or as far as."""
    # A place's run and the mark that its left neighbour leaves on it meet in one grouping.
    own = prefixes.select(*_PLACE, F.col(length).alias("n"), F.lit(0).alias("left"))
    left = prefixes.select("id", "h", (F.col("place") + 1).alias("place"), F.lit(0).alias("n"), F.col(length).alias("left"))
    both = own.union(left).groupBy(*_PLACE).agg(F.max("n").alias("n"), F.max("left").alias("left"))
    return both.filter((F.col("n") >= min_lines) & (F.col("left") <= F.col("n"))).select(*_PLACE, "n")


def _covered(single: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, h, line): the lines, counted from 0, under runs. Runs of a document overlap; each is cut where the next begins."""
    following = F.lead("place").over(Window.partitionBy("id", "h").orderBy("place"))
    stop = F.least(F.col("place") + F.col("n"), F.coalesce(following, F.col("place") + F.col("n")))
    places = runs.withColumn("stop", stop).select("id", "h", F.explode(F.sequence("place", F.col("stop") - 1)).alias("place"))
    return places.join(single.select(*_PLACE, "line"), _PLACE).select("id", "h", "line")


def _analysed(docs: DataFrame, id_col: str, text_col: str):
    """The texts, which of them stand for their copies, the repeated lines, and the names by depth."""
    base = _texts(docs, id_col, text_col)
    named = base.filter("id IS NOT NULL AND text IS NOT NULL")
    stands = written(named.groupBy("h", "u").agg(F.min("id").alias("id"), F.max("id").alias("last")), "line-texts")
    single = _repeated_lines(named, stands)
    return base, stands, single, _doubled(single.drop("line"))


def line_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 1) -> DataFrame:
    """Return (doc id, text_hash, place, n_lines): the maximal runs of `min_lines` solid lines or more that occur again.

    Places count a document's solid lines from 0. A run may recur anywhere, in its own document too; it is maximal if
    no longer run from its place recurs, nor one that begins a line before and reaches as far. Documents with equal texts
    are one (they stand under their least id). Null ids and texts have no runs; empty tables give no rows.
    """
    _, _, _, levels = _analysed(docs, id_col, text_col)
    lcp = _common_prefixes(levels)
    return _named(_maximal(lcp, "lcp", min_lines), id_col)


def later_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 1) -> DataFrame:
    """Return (doc id, text_hash, place, n_lines): the maximal runs that also begin at an earlier place.

    Earlier is in the order of id and then place; all else is as in `line_runs`. `line_dedup` deletes the lines under
    these runs.
    """
    _, _, _, levels = _analysed(docs, id_col, text_col)
    return _named(_maximal(_common_prefixes(levels), "earlier", min_lines), id_col)


def _named(runs: DataFrame, id_col: str) -> DataFrame:
    return runs.select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), "place", F.col("n").alias("n_lines"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 1) -> DataFrame:
    """Return (doc id, n_lines, n_removed, longest_run, kept_sha256, kept_text), one row per input row.

    A line is what stands between line feeds. Blank lines (white space alone) are in no run and never removed. A solid
    line is removed if it is in a run of `min_lines` solid lines of its document that also begins at an earlier place,
    in the order of id and then place; copies may overlap. n_lines counts solid lines; longest_run is how many of them in
    a row stand elsewhere too, at most (0: none; all, for a text that another id has as well). Kept lines are joined by
    line feeds; a null text counts as empty; texts of any length are read whole. A row with a null id removes and loses
    nothing. Rows with equal ids and texts are one document, and get equal results; of rows with equal ids the text's
    hash decides which comes first. Empty tables give no rows; other columns are ignored, whatever their names.
    """
    base, stands, single, levels = _analysed(docs, id_col, text_col)
    prefixes = written(_common_prefixes(levels), "line-lcp")
    longest = prefixes.groupBy("id", "h").agg(F.max("lcp").alias("longest"))
    gone = _covered(single, _maximal(prefixes, "earlier", min_lines)).groupBy("id", "h").agg(F.sort_array(F.collect_set("line")).alias("gone"))
    # A flag for each line up to the last one that goes, so that a line is looked up at its place.
    gap = lambda x, i: F.concat(F.array_repeat(F.lit(False), x - F.coalesce(F.get("gone", i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))
    flags = longest.join(gone, ["id", "h"], "left").select("id", "h", "longest", F.flatten(F.transform("gone", gap)).alias("flags"), F.lit(False).alias("copied"), F.lit(False).alias("whole"))
    # Texts that several ids have: under the least one they stay, but run on elsewhere; under the others they go.
    ids = base.select("id", "h", "u").join(stands.filter("last > id").select("h", "u", F.col("id").alias("least")), ["h", "u"]).filter("id IS NOT NULL").select("id", "h", "least").distinct()
    copied = ids.select("id", "h", F.lit(None).cast("int").alias("longest"), F.lit(None).cast("array<boolean>").alias("flags"), F.lit(True).alias("copied"), (F.col("id") > F.col("least")).alias("whole"))
    facts = flags.union(copied).groupBy("id", "h").agg(F.max("longest").alias("longest"), F.first("flags", ignorenulls=True).alias("flags"), F.max("copied").alias("copied"), F.max("whole").alias("whole"))
    facts = written(facts, "line-copies")
    # Removed lines grow with the texts: the same join at every size, never a broadcast.
    out = base.join(facts.hint("merge"), ["id", "h"], "left")
    solid = lambda x: x.rlike(_SOLID)
    n_lines = F.size(F.filter(_lines("text"), solid))
    out = out.withColumn("n", n_lines).withColumn("whole", F.coalesce("whole", F.lit(False)) & (F.col("n") >= min_lines))
    listed = F.filter(_lines("text"), lambda x, i: ~F.coalesce(F.get("flags", i), F.lit(False)))
    bare = F.filter(_lines("text"), lambda x: ~solid(x))
    kept = F.when(F.col("whole"), F.array_join(bare, "\n")).when(F.col("flags").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(listed, "\n"))
    removed = F.when(F.col("whole"), F.col("n")).otherwise(F.size(F.filter(F.coalesce("flags", F.array().cast("array<boolean>")), lambda x: x)))
    run = F.when(F.coalesce("copied", F.lit(False)), F.col("n")).otherwise(F.coalesce("longest", F.lit(0)))
    out = out.select("id", F.col("n").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), run.cast("long").alias("longest_run"), kept.alias("kept_text"))
    return out.select(F.col("id").alias(id_col), "n_lines", "n_removed", "longest_run", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"), "kept_text")
