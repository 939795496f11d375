"""SimHash document fingerprints of 128 bits, and a search by permuted block tables. Native only.

Terms are runs of two words, hashed to 128 bits; every occurrence votes +1 or -1 on each bit, so a term weighs as often
as it occurs. Votes are counted two bits to a long (32-bit lanes), 64 sums for 128 bits, inside one hash aggregate.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import words_column, written

BUCKET_BYTES = 24 << 20
LANES = (1 << 32) + 1


def _terms(text):
    """Pairs of neighbouring words; one word alone is paired with null; no words, no terms."""
    words = words_column(text)
    n = F.greatest(F.size(words) - 1, F.lit(1))
    return F.arrays_zip(F.slice(words, F.lit(1), n).alias("x"), F.slice(words, F.lit(2), n).alias("y"))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Return the keys and f1, f2 long, the two halves of each group's fingerprint; without terms they are 0."""
    t = texts.select(*keys, F.explode_outer(_terms(F.col(text_col))).alias("t"))
    t = t.select(*keys, F.col("t.x").isNotNull().cast("long").alias("w"), F.xxhash64("t.x", "t.y").alias("h1"), F.xxhash64(F.lit(1), "t.y", "t.x").alias("h2"))
    lane = lambda h, j: F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"{h}_{j}")
    votes = t.groupBy(*keys).agg(F.sum("w").alias("n"), *[lane(h, j) for h in ("h1", "h2") for j in range(32)])

    def half(h: str):
        low = [F.when(2 * F.col(f"{h}_{j}").bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("n"), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(32)]
        high = [F.when(2 * F.shiftrightunsigned(f"{h}_{j}", 32) > F.col("n"), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(32)]
        total = lambda xs: sum(xs[1:], xs[0].cast("long"))
        return F.shiftleft(total(high), 32).bitwiseOR(total(low))

    return votes.select(*keys, half("h1").alias("f1"), half("h2").alias("f2"))


def fingerprint_text(f1, f2):
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def likeness(a1, a2, b1, b2):
    """1 minus the share of bits that differ."""
    return 1 - (F.bit_count(F.col(a1).bitwiseXOR(F.col(b1))) + F.bit_count(F.col(a2).bitwiseXOR(F.col(b2)))) / F.lit(128.0)


def _literal(numbers: list[int]):
    """An array constant of any length: one text, which the optimizer folds."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _place_among(column, bounds: list[int]):
    """How many of `bounds` (falling) are at least the column's value, by two steps of about the root of their number."""
    step = math.isqrt(len(bounds)) + 1
    block = F.size(F.filter(_literal(bounds[::step]), lambda b: b >= column)) - 1
    inside = F.size(F.filter(F.slice(_literal(bounds), block * step + 1, F.lit(step)), lambda b: b >= column))
    return F.when(block >= 0, block * step + inside).otherwise(0)


def id_bounds(ids: DataFrame, n: int) -> list[int]:
    """Falling ids that cut `ids` (id) into about n ranges of equal numbers of rows; the first is the largest id.

    Quantiles of quantiles, so that each of about 2 * sqrt(n) summaries has sqrt(n) bounds: 8 bytes for each bucket.
    """
    some = ids.filter("id IS NOT NULL")
    m = math.isqrt(n - 1) + 1
    cuts = [i / m for i in range(1, m)] or [0.5]
    found = some.agg(F.percentile_approx("id", cuts, 100 * m).alias("q"), F.max("id").alias("top")).first()
    if found["top"] is None:
        return [0]
    coarse = sorted({*found["q"], found["top"]}, reverse=True)
    fine = some.groupBy(_place_among(F.col("id"), coarse).alias("part")).agg(F.percentile_approx("id", cuts, 100 * m).alias("q"), F.max("id").alias("top")).collect()
    return sorted({x for r in fine for x in (*r["q"], r["top"])}, reverse=True) if n > 1 else [found["top"]]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Return (bucket, id, h, text, rows, next_id, next_h, next_text): each document beside the next one by descending id.

    Buckets are ranges of ids, as many as the texts fill; their bounds are ids that occur. A bound's document is sent to
    the bucket above too, and the first document of all to the last bucket, so that each bucket knows its last
    document's follower. The text is shuffled once. Rows with equal ids and texts are one document, `rows` is their
    number; equal ids come in the order of the text's hash h. Documents with a null id have no follower (null).
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // BUCKET_BYTES + 1
    bounds = id_bounds(base.select("id"), n)
    bucket = F.when(F.col("id").isNull(), -1 - F.pmod("h", F.lit(n))).otherwise(_place_among(F.col("id"), bounds)).cast("long")
    place = base.withColumn("bucket", bucket)
    own = F.struct("bucket", F.lit(False).alias("guest"))
    above = F.struct(F.when(F.col("bucket") > 1, F.col("bucket") - 1).otherwise(F.lit(len(bounds))).cast("long").alias("bucket"), F.lit(True).alias("guest"))
    is_bound = F.coalesce(F.get(_literal(bounds), F.col("bucket").cast("int") - 1) == F.col("id"), F.lit(False))
    dealt = place.select("id", "h", "text", F.explode(F.when(is_bound, F.array(own, above)).otherwise(F.array(own))).alias("p")).select("p.bucket", "p.guest", "id", "h", "text")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), "h")
    again = F.lit(True)
    for c in ("id", "h", "guest"):
        again = again & F.lag(c).over(order).eqNullSafe(F.col(c))
    numbered = dealt.withColumns({"again": again, "nth": F.row_number().over(order), "all": F.count("*").over(Window.partitionBy("bucket"))})
    once = numbered.filter("NOT again")
    follow = lambda c: F.when(F.col("id").isNotNull(), F.lead(c).over(order)).alias(f"next_{c}")
    rows = F.coalesce(F.lead("nth").over(order), F.col("all") + 1) - F.col("nth")
    return once.select("bucket", "guest", "id", "h", "text", rows.alias("rows"), follow("id"), follow("h"), follow("text")).filter("NOT guest").drop("guest")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """Return (doc id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near).

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document by descending id, the first after the last. n_near is how many other fingerprints of the table's
    texts differ from the document's in `radius` bits or fewer, by a search of all in permuted block tables. Equal texts have equal fingerprints; texts without
    words have fingerprint 0. Null texts count as empty; texts of any length are read whole; a table of one row follows
    itself; rows that repeat id and text are one document and give equal rows; rows with a null id have no next document:
    their edited text loses its last half and near_next is null. Empty tables give no rows. Other columns are ignored,
    whatever their names.
    """
    chain = with_next(docs, id_col, text_col)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.coalesce(F.substring(F.col("next_text"), F.lit(1), half), F.lit("")))
    chain = chain.select("bucket", "id", "h", "rows", "next_id", "next_h", "text", edited.alias("edited"))
    facts = chain.select("id", "h", "rows", "next_id", "next_h", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("sha"))
    both = chain.select("bucket", "id", "h", F.posexplode(F.array("text", "edited")).alias("which", "text"))
    prints = fingerprints(both, ["bucket", "id", "h", "which"], "text").drop("bucket")
    # One table for both, so that one job makes them from one shuffle of the texts.
    table = written(prints.unionByName(facts, allowMissingColumns=True), "fingerprints")
    prints, facts = table.filter("which IS NOT NULL"), table.filter("which IS NULL").select("id", "h", "rows", "next_id", "next_h", "n_chars", "sha")

    def joined(left: DataFrame, which: int, by: tuple[str, str], x: str, how: str) -> DataFrame:
        right = prints.filter(F.col("which") == which).select(F.col("id").alias("r_id"), F.col("h").alias("r_h"), F.col("f1").alias(f"{x}1"), F.col("f2").alias(f"{x}2"))
        return left.join(right, F.col(by[0]).eqNullSafe(F.col("r_id")) & (F.col(by[1]) == F.col("r_h")), how).drop("r_id", "r_h")

    out = joined(joined(facts, 0, ("id", "h"), "o", "inner"), 1, ("id", "h"), "e", "inner")
    out = joined(out, 0, ("next_id", "next_h"), "n", "left")
    pairs = near_fingerprints(prints.filter("which = 0"), radius)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a1").alias("f1"), F.col("a2").alias("f2")), F.struct(F.col("b1").alias("f1"), F.col("b2").alias("f2")))).alias("f")).select("f.*")
    near = written(ends.groupBy("f1", "f2").agg(F.count("*").alias("n_near")), "near-fingerprints")
    out = out.join(near, (F.col("o1") == F.col("f1")) & (F.col("o2") == F.col("f2")), "left").withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select(
        F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), fingerprint_text("o1", "o2").alias("fingerprint"),
        fingerprint_text("e1", "e2").alias("edited_fingerprint"), likeness("o1", "o2", "e1", "e2").alias("near_edited"), likeness("o1", "o2", "n1", "n2").alias("near_next"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def near_fingerprints(prints: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs (a1, a2, b1, b2, distance) of different fingerprints (f1, f2) whose distance is at most `radius`, each once.

    The 128 bits are cut into radius + 2 blocks; two fingerprints within the radius agree on at least two of them, so
    each table keeps one choice of two blocks as its key. Copies of a fingerprint fall together first. Null and
    repeated rows are ignored.
    """
    blocks, bounds = radius + 2, []
    for i in range(blocks):
        bounds.append((128 * i // blocks, 128 * (i + 1) // blocks))
    bits = F.concat(F.lpad(F.bin("f1"), 64, "0"), F.lpad(F.bin("f2"), 64, "0"))
    one = prints.select("f1", "f2").dropna().distinct().withColumn("bits", bits)
    part = lambda i: F.substring("bits", bounds[i][0] + 1, bounds[i][1] - bounds[i][0])
    tables = F.array(*[F.xxhash64(F.lit(i), F.lit(j), part(i), part(j)) for i, j in combinations(range(blocks), 2)])
    keyed = one.select("f1", "f2", F.explode(tables).alias("key"))
    pairs = keyed.toDF("a1", "a2", "key").join(keyed.toDF("b1", "b2", "key"), "key").filter("struct(a1, a2) < struct(b1, b2)")
    distance = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    return pairs.select("a1", "a2", "b1", "b2", distance.alias("distance")).filter(f"distance <= {radius}").distinct()
