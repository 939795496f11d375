"""MinHash near-duplicate detection: one-permutation hashing, banded buckets, star-shaped candidate edges.

1. A text's shingle set is hashed once; the high bits of a hash choose one of `bands * rows` bins and each bin keeps
   its least hash. Empty bins borrow from the first filled bin of a fixed random order (optimal densification).
2. Texts with equal sets fall together at once (pre-aggregated by a 128-bit digest), so copies never meet in buckets.
3. Each band of rows is a bucket. A bucket emits a star around its least member, not all pairs. A text is first
   compared with the least of its centres alone, then with those centres that are in another component.
4. Candidates are confirmed by the exact ratio on full sets.
5. A star may miss a link between two leaves when one of them isn't linked to the centre. The texts of buckets whose
   members still lie in several components are joined by prefix filtering, which is exact: two sets can only be alike
   enough if they share one of the rarest shingles of each, n - ceil(0.8 n) + 1 of them, at places that leave room for
   the overlap. No bucket has a cap.

Before texts are compared, candidates pass two exact bounds: on sizes, and on 256-bit parity maps of the sets (each bit
that differs stands for at least one shingle that one set alone holds).

With 7 rows and 44 bands a pair at the 0.8 threshold meets in some bucket with probability 1 - 3e-5 if bins are
independent. Bins of small sets borrow from each other, so short texts miss more: about 1.5e-4 (README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_REGEX, components, merged, mix, shingle_sets, slices, unused, written

ROWS, BANDS = 7, 44
#: A text: the least id of the rows that have its shingle set, and the hash of that row's text. Ids alone don't do, as a
#: repeated id may have several texts.
NODE = "struct<id: bigint, t: bigint>"
PARITY = ["x0", "x1", "x2", "x3"]


def donor_order(bins: int) -> np.ndarray:
    """For each bin a fixed random order of all bins, the order in which an empty bin looks for a value."""
    rng = np.random.default_rng(20240117)
    return np.argsort(rng.random((bins, bins)), axis=1).astype(np.int32)


def signature(hashes: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a sorted set of hashes (not empty), densified."""
    bins = len(donors)
    place = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    filled = np.zeros(bins, bool)
    out = np.zeros(bins, np.uint64)
    filled[place[first]] = True
    out[place[first]] = hashes[first]
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = donors[empty]
        out[empty] = out[order[np.arange(len(empty)), np.argmax(filled[order], axis=1)]]
    return out


def _signer(words: int, rows: int, bands: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        donors = donor_order(rows * bands)
        salts = mix(np.arange(1, rows * bands + 1, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)
        for batch in batches:
            for part in slices(batch):
                n, sums, xors, keys, maps = [], [], [], [], []
                for s in shingle_sets(part.column(1), words):
                    n.append(len(s))
                    sums.append(mix(s + np.uint64(77)).sum(dtype=np.uint64))
                    xors.append(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xABCDEF)), initial=np.uint64(0)))
                    maps.append(np.packbits(np.bincount((mix(s) >> np.uint64(56)).astype(np.int64), minlength=256) & 1).view(np.int64))
                    if len(s):
                        keys.append(mix((signature(s, donors).reshape(bands, rows) * salts).sum(axis=1, dtype=np.uint64)))
                ends = np.concatenate(([0], np.cumsum([bands * (k > 0) for k in n]))).astype(np.int32)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(n, pa.int64()),
                        pa.array(np.array(sums, np.uint64).view(np.int64)),
                        pa.array(np.array(xors, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
                        *[pa.array(np.array([m[i] for m in maps], np.int64)) for i in range(4)],
                    ],
                    ["id", "t", "n", "h1", "h2", "keys", *PARITY],
                )

    return sign


def _checker(words: int, percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            for part in slices(batch, 3):
                a, good = part.column(0).to_pylist(), []
                for i, right in enumerate(shingle_sets(part.column(3), words)):
                    if a[i] != last:
                        last, kept = a[i], next(shingle_sets(part.column(2).slice(i, 1), words))
                    same = len(np.intersect1d(kept, right, assume_unique=True))
                    good.append(100 * same >= percent * (len(kept) + len(right) - same))
                yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return check


def _shingle_rows(words: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column(1), words))
                owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(grams.view(np.int64))], ["rep", "g"])

    return make


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The (a, b) of `pairs` whose whole shingle sets are alike enough. The hot side, a, is joined last."""
    right = pairs.join(texts.toDF("b", "right"), "b")
    both = right.join(texts.toDF("a", "left"), "a").select("a", "b", "left", "right")
    return written(both.mapInArrow(_checker(words, percent), f"a {NODE}, b {NODE}"), "links")


def _rooted(rows: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """`rows` with {column}_root, the component of the text in `column`."""
    roots = found.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))
    return rows.join(roots, column, "left").withColumn(f"{column}_root", F.coalesce(f"{column}_root", column))


def _sharing_rare_shingles(texts: DataFrame, facts: DataFrame, found: DataFrame, words: int, percent: int) -> DataFrame:
    """Every pair (a, b) of texts in different components that may be alike enough, by prefix filtering."""
    grams = written(texts.mapInArrow(_shingle_rows(words), f"rep {NODE}, g long"), "open-shingles")
    # Tables between the steps: joins of two tables by `g` let AQE split a shingle that very many texts hold.
    common = written(grams.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1"), "shared-shingles")
    each = Window.partitionBy("rep").orderBy("df", "g")  # bounded by a text's length
    # Shingles of one text alone are the rarest: they have the first places.
    shared = grams.join(common, "g").withColumn("k", F.row_number().over(each)).withColumn("shared", F.count("*").over(Window.partitionBy("rep")))
    rare = shared.join(facts, "rep").withColumn("k", F.col("k") + F.col("n") - F.col("shared")).filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    rare = written(_rooted(rare.select("g", "rep", "k", "n", *PARITY), found, "rep"), "rare-shingles")
    mixed = rare.groupBy("g").agg(F.min("rep_root").alias("x"), F.max("rep_root").alias("y")).filter("x <> y").select("g")
    rare = written(rare.join(written(mixed, "mixed-shingles"), "g"), "open-rare-shingles")
    left = rare.select("g", F.col("rep").alias("a"), "n", "k", F.col("rep_root").alias("a_root"), *PARITY)
    right = rare.select("g", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("k").alias("l"), F.col("rep_root").alias("b_root"), *[F.col(x).alias(f"y{x[1]}") for x in PARITY])
    # Of the shared rare shingles the first one leaves this much room at most; the overlap must fit in it.
    room = f"{100 + percent} * (1 + least(n - k, m - l)) >= {percent} * (n + m)"
    pairs = left.join(right, "g").filter("a < b AND a_root <> b_root").filter(_alike(percent)).filter(room).filter(_near_maps(percent))
    return pairs.select("a", "b").distinct()


def _named(facts: DataFrame, key: str, size: str, maps: str) -> DataFrame:
    return facts.select(F.col("rep").alias(key), F.col("n").alias(size), *[F.col(x).alias(f"{maps}{x[1]}") for x in PARITY])


def _near_maps(percent: int) -> str:
    """Bits of the parity maps x and y that differ are no more than shingles may differ."""
    return f"{100 + percent} * ({' + '.join(f'bit_count(x{i} ^ y{i})' for i in range(4))}) <= {100 - percent} * (n + m)"


def _alike(percent: int) -> str:
    """Sizes n, m that allow the wanted ratio."""
    return f"100 * least(n, m) >= {percent} * greatest(n, m)"


def near_texts(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(id, t, n, root) for each row: t is the text's hash, n the size of its shingle set, root the least (id, t) reached.

    root is null without shingles or without an id.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = base.select("id", "text", F.xxhash64("text").alias("t"))
    signed = written(base.mapInArrow(_signer(words, rows, bands), "id long, t long, n long, h1 long, h2 long, keys array<long>, x0 long, x1 long, x2 long, x3 long"), "signatures")

    usable = signed.filter("n > 0 AND id IS NOT NULL")
    classes = usable.groupBy("n", "h1", "h2").agg(F.min(F.struct("id", "t")).alias("rep"), F.first("keys").alias("keys"), *[F.first(x).alias(x) for x in PARITY])
    keyed = classes.select("rep", "n", F.posexplode("keys").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "rep", "n")
    centres = keyed.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("c"), F.count("*").alias("size")).filter("size > 1")
    members = written(keyed.join(centres, "bucket").select("bucket", "rep", "n", F.col("c.rep").alias("c"), F.col("c.n").alias("m"), "size"), "buckets")

    facts = classes.select("rep", "n", *PARITY)
    stars = members.filter("rep <> c").filter(_alike(percent)).select(F.col("c").alias("a"), F.col("rep").alias("b")).distinct()
    both = stars.join(_named(facts, "b", "m", "y"), "b").join(_named(facts, "a", "n", "x"), "a")
    stars = written(both.filter(_near_maps(percent)).select("a", "b"), "stars")
    used = members.filter("size > 2").select("rep").union(stars.select("a")).union(stars.select("b")).distinct()
    # Rows that repeat id and text are one text; joined by id, so that one shuffle of the texts serves both steps.
    found_in = base.filter("id IS NOT NULL").join(used.select(F.col("rep.id").alias("id"), F.col("rep.t").alias("u")), "id").filter("t = u")
    texts = written(found_in.groupBy("id", "t").agg(F.first("text").alias("text")).select(F.struct("id", "t").alias("rep"), "text"), "texts")

    first = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = written(components(_confirmed(first, texts, words, percent)), "components")
    others = _rooted(_rooted(stars, found, "a"), found, "b").filter("a_root <> b_root").select("a", "b").join(first, ["a", "b"], "left_anti")
    found = merged(found, _confirmed(others, texts, words, percent))

    rooted = _rooted(members.filter("size > 2").select("bucket", "rep"), found, "rep")
    mixed = rooted.groupBy("bucket").agg(F.min("rep_root").alias("x"), F.max("rep_root").alias("y")).filter("x <> y").select("bucket")
    unsure = rooted.join(mixed, "bucket", "left_semi").select("rep").distinct()
    more = _sharing_rare_shingles(texts.join(unsure, "rep", "left_semi"), facts, found, words, percent)
    found = merged(found, _confirmed(more, texts, words, percent))

    rep_root = classes.select("n", "h1", "h2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n", "h1", "h2", F.coalesce("root", "rep").alias("root"))
    return signed.select("id", "t", "n", "h1", "h2").join(rep_root, ["n", "h1", "h2"], "left").select("id", "t", "n", F.when(F.col("id").isNotNull(), F.col("root")).alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS
) -> DataFrame:
    """Return (doc id, n_shingles, component_id, kept), one row per input row.

    Texts link if 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the least id that
    links reach. Null, empty and blank texts have no shingles and link with nothing; a text of fewer words than a
    shingle is one shingle. Equal texts link (n_shingles > 0). Rows that repeat an id are linked by their texts alone:
    each of them has the component of its text. Rows whose id is null link with nothing: component_id is null and kept
    is true. An empty table gives no rows. Other columns of `docs` are ignored, whatever their names.
    """
    near = near_texts(docs, id_col, text_col, words, percent, rows, bands)
    out = near.select("id", "n", F.coalesce("root.id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns kept, without near-duplicates: of each component one row of the least id.

    Rows of one id count by their texts: near ones are duplicates of each other (the one with the least hash of its text
    stays, one row of those that are equal), others are documents of their own. Documents without words (null, empty,
    blank) are nobody's duplicate and stay, as do rows with a null id. Texts are compared whole. An empty table gives
    no rows. Columns may have any names.
    """
    key, hashed = unused("near_id", docs), unused("near_text", docs)
    near = near_texts(docs, id_col, text_col, words, percent).filter("root = struct(id, t)").select(F.col("id").alias(key), F.col("t").alias(hashed)).distinct()
    t = unused("text_hash", docs)
    named = docs.withColumn(t, F.xxhash64(F.col(text_col).cast("string")))
    alone = F.col(id_col).isNull() | ~F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(WORD_REGEX)
    # The hash is a condition beside the key, so that rows are dealt by id and need no second shuffle for the last step.
    mine = (F.col(id_col).cast("long") == F.col(key)) & F.col(t).between(F.col(hashed), F.col(hashed))
    kept = named.filter(~alone).join(near, mine, "left_semi").dropDuplicates([id_col, t])
    return kept.union(named.filter(alone)).drop(t)
