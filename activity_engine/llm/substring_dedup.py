"""Repeated word passages across documents, by prefix-partitioned suffix trees over a sparse set of suffixes.

Only nodes at depth `window` (50 words) decide what goes, so not every suffix needs a place in a tree. Each window of 50
words is hung on one suffix that begins inside it: the one whose first 16 words have the least hash (its minimizer).
Neighbouring windows share it, so about one suffix in 18 is kept; equal windows hang on equal suffixes.

1. Prefixes. Suffixes are counted by their 16-word prefix. Those that one text alone holds can't repeat and are cut.
2. Groups. A prefix that is left is a group if its subtree fits a task's memory: the bytes that the words of its windows
   take while the tree is built, counted beforehand (GROUP_BYTES). The windows of a larger group are hung on prefixes of
   24, 32 and 40 words, each within the one before, until they fit; what one text alone holds is cut at each length.
3. Subtrees. A group's windows are sorted as suffixes by prefix doubling over word numbers (exact, no hashes): names at
   depth 1, 2, 4, .. 32, 50. Windows with one name at depth 50 are the leaves of one internal node of that depth.
4. Nodes of many leaves. A group that is too large at 40 words too holds few different windows, each in very many places:
   there each window is its node, told by 128 bits of hash. Least documents are found by pre-aggregation, so that a
   passage that a third of all documents hold is never gathered in one place.
5. Windows under a node whose least document is another, smaller one are copies. Neighbouring copies of a document join
   to its repeats (`repeats`), which can't be extended on either side; their words are removed.

Documents with equal texts fall together first: one of them stands for all, the others go whole. The plan is the same at
every size; a prefix's length follows from its group's bytes alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix, ngram_hashes, slices, text_bytes, word_hashes, word_spans, written

PREFIX, STEP, CHUNK_BYTES = 16, 8, 2 << 20
#: What a subtree may take while it is built, and what it takes for each word and for each byte of text (measured).
GROUP_BYTES, WORD_COST, BYTE_COST = 128 << 20, 96, 4
RUNS = "id long, t long, place int, n int"


def least_prefixes(words: np.ndarray, window: int, prefix: int) -> np.ndarray:
    """For each window, the least hash of the `prefix`-word runs inside it."""
    best = ngram_hashes(words, prefix)
    span, reach = window - prefix + 1, 1
    while reach < span:
        step = min(reach, span - reach)
        best = np.minimum(best[: len(best) - step], best[step:])
        reach += step
    return best


def prefix_lengths(window: int, prefix: int) -> list[int]:
    """The lengths of prefixes, each for what doesn't fit at the one before; all shorter than a window but the first."""
    return [prefix, *range(prefix + STEP, window, STEP)]


def _joined(row: np.ndarray, place: np.ndarray, keys: np.ndarray):
    """(row, place, n, key) of each run of neighbouring windows with one key."""
    new = np.ones(len(row), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(new)
    return row[at], place[at], np.diff(at, append=len(row)), keys[at]


class _Windows:
    """The windows of some texts: their words, and the keys that their prefixes of each length have."""

    def __init__(self, texts: pa.Array, window: int):
        self.window = window
        self.words, self.first = word_hashes(texts, False)
        self.raw, at = text_bytes(texts)
        self.starts, self.stops, _ = word_spans(self.raw, at)
        n = np.maximum(np.diff(self.first) - window + 1, 0)
        self.row = np.repeat(np.arange(len(n)), n)
        self.place = np.arange(len(self.row)) - np.repeat(np.cumsum(n) - n, n)

    def begin(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.first[:-1][row] + place

    def keys(self, row: np.ndarray, place: np.ndarray, length: int, within: np.ndarray | None = None) -> np.ndarray:
        """The least hash of the windows' runs of `length` words, within the key of the shorter prefix."""
        if not len(row):
            return np.zeros(0, np.uint64)
        least = least_prefixes(self.words, self.window, length)[self.begin(row, place)]
        return least if within is None else mix(within + least * np.uint64(0x9E3779B97F4A7C15))

    def ends(self, row: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes at which runs of windows begin and end."""
        begin = self.begin(row, place)
        return self.starts[begin], self.stops[begin + n + self.window - 2]

    def sized(self, t: pa.Array, runs) -> pa.RecordBatch:
        """(t, key, size) of runs of windows: size is the memory that a run takes in a subtree."""
        row, place, n, keys = runs
        a, b = self.ends(row, place, n)
        size = (b - a) * BYTE_COST + (n + self.window - 1) * WORD_COST
        return pa.RecordBatch.from_arrays([t.take(pa.array(row)), pa.array(keys.view(np.int64)), pa.array(size.astype(np.int64))], ["t", "key", "size"])


def _prefixes(window: int, prefix: int):
    """(t, key, size) of each run of windows of each text, by the shortest prefix."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                w = _Windows(part.column(0), window)
                yield w.sized(part.column(1), _joined(w.row, w.place, w.keys(w.row, w.place, prefix)))

    return make


def _looked_up(lists: pa.Array, row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among its row's own list (sorted structs of key and large), and whether it is large there."""
    ends = lists.offsets.to_numpy()
    known, flags = (lists.values.field(f).to_numpy(zero_copy_only=False) for f in ("key", "large"))
    hit, large = np.zeros(len(row), bool), np.zeros(len(row), bool)
    bounds, signed = np.searchsorted(row, np.arange(len(lists) + 1)), keys.view(np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        mine = known[ends[i] : ends[i + 1]]
        if a < b and len(mine):
            at = np.minimum(np.searchsorted(mine, signed[a:b]), len(mine) - 1)
            hit[a:b] = mine[at] == signed[a:b]
            large[a:b] = hit[a:b] & flags[ends[i] : ends[i + 1]][at]
    return hit, large


def _longer(window: int, lengths: list[int]):
    """(t, key, size) of the runs of windows of large groups, by each of the longer prefixes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                w = _Windows(part.column("text"), window)
                keys = w.keys(w.row, w.place, lengths[0])
                _, hot = _looked_up(part.column("keys"), w.row, keys)
                row, place, keys = w.row[hot], w.place[hot], keys[hot]
                for length in lengths[1:]:
                    keys = w.keys(row, place, length, keys)
                    yield w.sized(part.column("t"), _joined(row, place, keys))

    return make


def _dealt(w: _Windows, lists: pa.Array, lengths: list[int]):
    """The runs (row, place, n, key) of groups that fit, and the windows (row, place) that are large at every length."""
    row, place, keys = w.row, w.place, None
    runs = []
    for length in lengths:
        keys = w.keys(row, place, length, keys)
        hit, large = _looked_up(lists, row, keys)
        fits = hit & ~large
        runs.append(_joined(row[fits], place[fits], keys[fits]))
        row, place, keys = row[large], place[large], keys[large]
    return tuple(np.concatenate(x) for x in zip(*runs, strict=True)), (row, place)


def _grouped(window: int, lengths: list[int]):
    """The runs of groups that fit memory, each with its words: what a subtree is built of."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                w = _Windows(part.column("text"), window)
                (row, place, n, keys), _ = _dealt(w, part.column("keys"), lengths)
                data = w.raw.tobytes()
                texts = [data[a:b].decode() for a, b in zip(*(x.tolist() for x in w.ends(row, place, n)), strict=True)]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(rows), part.column("t").take(rows), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(texts, pa.string())],
                    ["id", "t", "place", "n", "key", "words"],
                )

    return make


def _single(window: int, lengths: list[int]):
    """The windows of groups that are too large at every length: each is a node, named by two hashes of its words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                w = _Windows(part.column("text"), window)
                _, (row, place) = _dealt(w, part.column("keys"), lengths)
                start = w.begin(row, place)
                k1, k2 = (ngram_hashes(x, window)[start].view(np.int64) if len(start) else np.zeros(0, np.int64) for x in (w.words, w.words ^ np.uint64(0x5851F42D4C957F2D)))
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("t").take(rows), pa.array(place.astype(np.int32)), pa.array(k1), pa.array(k2)], ["id", "t", "place", "k1", "k2"])

    return make


def word_numbers(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A number for each word: equal words, and only these, have equal numbers."""
    ends = np.concatenate(([0], np.cumsum(stops - starts)))
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    np.add.at(inside, stops, -1)
    packed = raw[np.cumsum(inside[:-1]).astype(bool)]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(packed.tobytes())])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def names_at(numbers: np.ndarray, depth: int) -> np.ndarray:
    """Prefix doubling: the rank of the `depth` words that begin at each place; equal runs, and only these, have one rank."""
    names, reach = numbers, 1
    while reach < depth:
        step = min(reach, depth - reach)
        left, right = names[: len(names) - step], names[step:]
        if not len(left):
            return left
        names = np.unique(left * (int(names.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)
        reach += step
    return names


def copies_in(rows: pa.Table, window: int) -> pa.Table:
    """The (id, t, place, n) of runs of windows of these groups whose node has a smaller document."""
    raw, at = text_bytes(rows.column("words").combine_chunks())
    starts, stops, first = word_spans(raw, at)
    n, ids = rows.column("n").to_numpy().astype(np.int64), rows.column("id").to_numpy()
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    node = names_at(word_numbers(raw, starts, stops), window)[first[:-1][owner] + inside]
    least = np.full(int(node.max()) + 1 if len(node) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, node, ids[owner])
    copy = ids[owner] > least[node]
    begins, ends = copy.copy(), copy.copy()
    same = owner[1:] == owner[:-1]
    begins[1:] &= ~(copy[:-1] & same)
    ends[:-1] &= ~(copy[1:] & same)
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    who = pa.array(owner[a])
    place = rows.column("place").to_numpy()[owner[a]] + inside[a]
    return pa.table([rows.column("id").take(who), rows.column("t").take(who), pa.array(place.astype(np.int32)), pa.array((b - a + 1).astype(np.int32))], ["id", "t", "place", "n"])


def _subtrees(window: int):
    """Builds subtrees of rows that are sorted by key: as many whole groups at a time as CHUNK_BYTES hold."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def complete(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy()
            stop = len(keys) if last else int(np.searchsorted(keys == keys[-1], True))
            if stop:
                yield from copies_in(table.slice(0, stop), window).to_batches()
            held[:] = table.slice(stop).to_batches() if stop < len(keys) else []

        for batch in batches:
            for part in slices(batch, 5, CHUNK_BYTES):
                held.append(part)
                if sum(x.nbytes for x in held) >= CHUNK_BYTES:
                    yield from complete(False)
        if held:
            yield from complete(True)

    return build


def _remover(window: int, with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, at = text_bytes(part.column(1))
                whole = part.column(3).to_pylist()
                n, removed, kept = [], [], []
                for i, runs in enumerate(part.column(2)):
                    words = raw[at[i] : at[i + 1]].tobytes().split()
                    n.append(len(words))
                    if whole[i] and len(words) >= window:
                        words = []
                    elif runs.is_valid and len(runs):
                        place, length = (runs.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("place", "n"))
                        cover = np.zeros(len(words) + 1, np.int64)
                        np.add.at(cover, place, 1)
                        np.add.at(cover, place + length + window - 1, -1)
                        gone = np.cumsum(cover[:-1]) > 0
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    removed.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([x.decode("utf-8", "replace") if with_text else None for x in kept], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                    ["id", "n", "removed", "kept", "sha"],
                )

    return remove


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, t): t is the text's hash."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))


def _copies(base: DataFrame, window: int, prefix: int, group_bytes: int) -> DataFrame:
    """(id, t, runs, whole) of the texts that have copies: runs of windows (place, n), or the whole text."""
    named = base.filter("id IS NOT NULL AND text IS NOT NULL")
    # Of equal texts (128 bits) the least id stands for all; the others are copies as a whole.
    light = named.select("id", "t", F.xxhash64(F.lit(1), "text").alias("u"))
    stands = written(light.groupBy("t", "u").agg(F.min("id").alias("stands"), F.count("*").alias("rows")), "texts")
    whole = light.join(stands.filter("rows > 1"), ["t", "u"]).filter("id > stands").select("id", "t").distinct()

    lengths, sized = prefix_lengths(window, prefix), "t long, key long, size long"
    state = lambda runs: runs.groupBy("key").agg(F.min("t").alias("x"), F.max("t").alias("y"), F.sum("size").alias("size")).filter("x <> y").select("key", (F.col("size") > group_bytes).alias("large"))
    own = lambda runs, groups: runs.join(groups, "key").groupBy("t").agg(F.sort_array(F.collect_set(F.struct("key", "large"))).alias("keys"))
    short = named.select("text", "t").mapInArrow(_prefixes(window, prefix), sized)
    wanted = written(stands.join(own(short, written(state(short), "prefixes")), "t").select(F.col("stands").alias("id"), F.col("t").alias("v"), "keys"), "wanted")
    # Only texts with windows in large groups are read for longer prefixes; Spark broadcasts their keys if they are few.
    hot = written(wanted.select("id", "v", F.filter("keys", lambda k: k.large).alias("keys")).filter("size(keys) > 0"), "hot")
    longer = written(named.join(hot, "id").filter("t = v").select("id", "t", "text", "keys").mapInArrow(_longer(window, lengths), sized), "longer")
    deeper = own(longer, state(longer)).select(F.col("t").alias("v"), F.col("keys").alias("more"))
    all_keys = F.when(F.col("more").isNull(), F.col("keys")).otherwise(F.array_sort(F.concat("keys", "more")))
    wanted = written(wanted.join(deeper, "v", "left").select("id", "v", all_keys.alias("keys")), "all_keys")
    texts = named.join(wanted.hint("merge"), "id").filter("t = v").select("id", "t", "text", "keys")

    trees = texts.mapInArrow(_grouped(window, lengths), f"{RUNS}, key long, words string")
    found = trees.repartition("key").sortWithinPartitions("key").mapInArrow(_subtrees(window), RUNS)
    single = texts.mapInArrow(_single(window, lengths), "id long, t long, place int, k1 long, k2 long")
    nodes = written(single.groupBy("k1", "k2").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x < y").select("k1", "k2", "x"), "nodes")
    found = found.union(single.join(nodes, ["k1", "k2"]).filter("id > x").select("id", "t", "place", F.lit(1).alias("n")))
    runs = found.groupBy("id", "t").agg(F.sort_array(F.collect_set(F.struct("place", "n"))).alias("runs"))
    none = F.lit(None).cast("array<struct<place: int, n: int>>")
    return written(runs.withColumn("whole", F.lit(False)).union(whole.select("id", "t", none, F.lit(True))), "copies")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, prefix: int = PREFIX, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Return (doc id, text_hash, place, n_words): the repeats of `window` words or more in documents that aren't the first to have them.

    A repeat is a run of words that windows cover which also begin in a document with a smaller id, and that can't be
    extended. Documents whose whole text stands under a smaller id have place 0 and no n_words.
    """
    got = _copies(_base(docs, id_col, text_col), window, prefix, group_bytes)
    one = got.filter("NOT whole").select("id", "t", F.explode("runs").alias("r")).select("id", "t", F.col("r.place").alias("a"), (F.col("r.place") + F.col("r.n") + window - 1).alias("b"))
    order = Window.partitionBy("id", "t").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # Windows that follow each other join; words that only touch do not.
    numbered = one.withColumn("new", (F.coalesce(before, F.lit(-1)) - window + 1 < F.col("a")).cast("int")).withColumn("k", F.sum("new").over(order))
    joined = numbered.groupBy("id", "t", "k").agg(F.min("a").alias("place"), (F.max("b") - F.min("a")).alias("n_words")).drop("k")
    out = joined.union(got.filter("whole").select("id", "t", F.lit(0), F.lit(None).cast("int")))
    return out.select(F.col("id").alias(id_col), F.col("t").alias("text_hash"), "place", "n_words")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, prefix: int = PREFIX, with_text: bool = True, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Return (doc id, n_words, n_removed, kept_sha256, kept_text), one row per input row; kept_text is null unless wanted.

    A word is removed if a window of `window` consecutive words of its document covers it and the window's words also
    begin in a document with a smaller id; all windows are judged on the input. Kept words are joined by one space.
    A null or blank text has no words. A row with a null id removes nothing and loses nothing. Rows that repeat an id
    are one document for the purpose of "smaller id", each with its own text. Texts shorter than a window never change;
    texts of any length are read whole. Empty tables give no rows; other columns are ignored, whatever their names.
    """
    base = _base(docs, id_col, text_col)
    copies = _copies(base, window, prefix, group_bytes).select("id", F.col("t").alias("v"), "runs", "whole")
    # Copies grow with the texts: the same join at every size, never a broadcast.
    both = base.join(copies.hint("merge"), (F.col("t") == F.col("v")) & (base["id"] == copies["id"]), "left").select(base["id"], "text", "runs", "whole")
    out = both.mapInArrow(_remover(window, with_text), "id long, n long, removed long, kept string, sha string")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.col("removed").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.col("kept").alias("kept_text"))
