"""Shared helpers of the corpus operators: storage for cut lineages, words, hashing, connected components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import shared_dir

#: A word is a run of bytes other than these (space, tab, line feed, vertical tab, form feed, carriage return).
SPACES = b" \t\n\x0b\x0c\r"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32
_BASE, _NGRAM_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


# --- storage ---------------------------------------------------------------------------------------------------


_mine: ContextVar[list[str] | None] = ContextVar("paths that freeing deletes", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is deleted when the driver ends, or by `freeing`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (mine := _mine.get()) is not None:
        mine.append(path)
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what this thread wrote to new paths meanwhile; what other threads write stays."""
    paths: list[str] = []
    token = _mine.set(paths)
    try:
        yield
    finally:
        _mine.reset(token)
        for path in paths:
            _delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: it outlives the executors that made it."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, *frames: DataFrame) -> str:
    """`name` with so many underscores before it that no column of the frames has that name."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --- words and hashes ------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo 2**64 for j < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _powers[base] = have = (both[0], both[1])
    return have[0][:n], have[1][:n]


def slices(batch: pa.RecordBatch, column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most `most` bytes of text (or one row)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array and the n + 1 places where they begin; null is empty."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end in `raw`, and the n + 1 places in these lists where each text's words begin."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~_IS_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[:-1][np.diff(at) > 0]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edge[1:] - 1] = inside[edge[1:] - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, at)


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, and the n + 1 places where each text's words begin.

    Words' hashes are differences of running polynomial sums, so no Python code runs per word. Sums run over pieces
    of about 1 MB that begin at a word, which bounds memory for a text of any length.
    """
    raw, at = text_bytes(texts)
    if lower:
        raw = _TO_LOWER[raw]
    starts, stops, first = word_spans(raw, at)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + (1 << 20), side="right")))
        lo, hi = int(starts[i]), int(stops[j - 1])
        up, down = powers(_BASE, hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        s, e = starts[i:j] - lo, stops[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0x94D049BB133111EB))
        i = j
    return out, first


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words; len(words) - n + 1 values, runs over text borders included."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(_NGRAM_BASE, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:m]) * down[:m] + np.uint64(n))


def shingle_sets(texts: pa.Array, n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the n-word shingles of each text; with fewer words, of all words as one."""
    words, first = word_hashes(texts, lower)
    grams = ngram_hashes(words, n)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield ngram_hashes(words[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)


def lower_ascii(column):
    """Lower-case A-Z alone, whatever the locale."""
    return F.translate(column, UPPER, LOWER)


def words_column(column):
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(column, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


# --- connected components --------------------------------------------------------------------------------------


def _are_stars(edges: DataFrame) -> bool:
    """Whether each a of `edges` (a > b) has one b, and no b is an a: then each b is the least node of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("links"), F.lit(0).alias("centre")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("links").alias("links"), F.max("centre").alias("centre")).filter("links + centre > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Label every node of `edges` (a long, b long) with its component's smallest node: (node, root).

    Alternates large-star and small-star steps, each an aggregate for the least neighbour and a join back, so that a
    node with very many neighbours is never gathered in one place. The edges of every round are written; edges that are
    stars take no round. Empty edges give no rows.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while not _are_stars(e):
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(small.union(least.select("a", "m")).distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """`found` (node, root) after further links (a, b): only components that these touch are worked out again. No links, no change."""
    if links.isEmpty():
        return found
    root = lambda side: found.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    named = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select("a", "b", F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y"))
    moved = components(named.select(F.col("x").alias("a"), F.col("y").alias("b"))).toDF("root", "to")
    nodes = found.union(named.select("x", "x").union(named.select("y", "y"))).distinct()
    return written(nodes.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")).distinct(), "components")
