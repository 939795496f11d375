"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item of q shingles is much smaller than a document of u shingles, so the Jaccard ratio of the two tends to 0
and a signature of the whole document can't show containment. The search is asymmetric instead: an item's signature
is the q' least hashes of its own shingles, and a document matches a signature value if its shingle set holds it,
which happens with probability equal to the containment. Items are partitioned by size, and a partition's bound on
the size fixes its signature's length so that an item of at least the wanted containment is found with probability
1 - 1e-9 or better (with certainty where the signature holds more shingles than may be missing). Candidates are
verified on all shingles of the item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ngram_hashes, slices, unused, word_hashes, written

#: Signature values (8 bytes each) that are broadcast at once; a benchmark with more of them is searched in blocks.
BLOCK_VALUES = 1 << 20


def signature_length(size: int, threshold: float, miss: float = 1e-9) -> int:
    """Values that items of `size` shingles at most need: enough by probability, or more than may be missing."""
    certain = size - math.ceil(threshold * size - 1e-9) + 1
    likely = math.ceil(math.log(miss) / math.log(max(1e-12, 1 - threshold))) if threshold < 1 else 1
    return max(1, min(certain, likely))


def _item_shingles(words: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ks, sets = [], [], []
            hashed, first = word_hashes(batch.column(1), True)
            for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                if b > a:
                    k = min(words, int(b - a))
                    ids.append(batch.column(0)[i].as_py())
                    ks.append(k)
                    sets.append(np.unique(ngram_hashes(hashed[a:b], k)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["item", "k", "hashes"])

    return make


def _doc_shingles(lengths: list[int], wanted):
    """(id, hash) of the shingles of each text whose hash is in the broadcast array `wanted` (not empty, sorted)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = wanted.value
        for batch in batches:
            for part in slices(batch):
                hashed, first = word_hashes(part.column(1), True)
                owner = np.repeat(np.arange(len(part)), np.diff(first))
                for k in lengths:
                    grams = ngram_hashes(hashed, k).view(np.int64)
                    hit = owner[: len(grams)] == owner[k - 1 :]
                    hit &= values[np.minimum(np.searchsorted(values, grams), len(values) - 1)] == grams
                    rows = np.flatnonzero(hit)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[rows])), pa.array(grams[rows])], ["id", "hash"])

    return make


def _verifier(words: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4):
                hashed, first = word_hashes(part.column(4), True)
                shared = []
                for i, (k, item) in enumerate(zip(part.column(2).to_pylist(), part.column(3), strict=True)):
                    grams = ngram_hashes(hashed[first[i] : first[i + 1]], k).view(np.int64)
                    shared.append(len(np.intersect1d(grams, item.values.to_numpy(zero_copy_only=False))))
                sizes = pa.compute.list_value_length(part.column(3)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sizes, pa.array(shared, pa.int64())], ["id", "item", "n", "shared"])

    return verify


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    words: int = 5, percent: int = 80, block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """Return (doc id, item id, n_shingles, n_shared) where 100 * n_shared >= percent * n_shingles.

    Shingles are of `words` lower-cased (A-Z) words, an item's distinct ones; an item of fewer words is one shingle of
    all its words. Null, empty and blank items match nothing, nor do such texts. Rows with a null id are left out.
    Items with equal texts are all reported. A document row that is repeated is reported once for each item; rows that
    repeat an id with other texts are searched each. Texts of any length are searched whole. Empty tables give no rows.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL")
    texts = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("item IS NOT NULL")
    sets = written(texts.mapInArrow(_item_shingles(words), "item long, k int, hashes array<long>"), "items")

    # A partition holds the sizes in (2**(p-1), 2**p]; its bound fixes the signature's length.
    bound = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("hashes").cast("double"))))
    kinds = sets.select(bound.cast("long").alias("bound"), "k").distinct().collect()  # at most 31 partitions times `words` values
    lengths = sorted({r["k"] for r in kinds})
    take = F.lit(1)
    for s in sorted({r["bound"] for r in kinds}):
        take = F.when(bound == s, F.lit(signature_length(s, percent / 100))).otherwise(take)
    signed = written(sets.select("item", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), take)).alias("hash")), "item-signatures")

    # Each block of values is a scan of the documents; nothing but documents' hits is shuffled, however many blocks.
    blocks = max(1, -(-signed.count() // block_values))
    hits = docs.sparkSession.createDataFrame([], "id long, hash long")
    for block in range(blocks if lengths else 0):
        part = signed.filter(F.pmod("hash", F.lit(blocks)) == block).select("hash").distinct()
        values = np.sort(part.toPandas()["hash"].to_numpy(np.int64))
        if len(values):
            hits = hits.union(base.mapInArrow(_doc_shingles(lengths, spark.sparkContext.broadcast(values)), "id long, hash long"))
    candidates = hits.distinct().join(signed, "hash").select("id", "item").distinct()
    # Items are short, so they go to the documents: a common item's documents don't meet in one place with their texts.
    both = candidates.join(sets, "item").join(base, "id").select("id", "item", "k", "hashes", "text")
    checked = both.mapInArrow(_verifier(words), "id long, item long, n long, shared long").filter(f"100 * shared >= {percent} * n")
    return checked.distinct().select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("n").alias("n_shingles"), F.col("shared").alias("n_shared"))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns kept, that hold no item.

    A document without words (null, empty, blank) holds nothing and stays, as do rows with a null id. Rows that repeat
    an id go together if one of them holds an item. Texts are searched whole. Items without words forbid nothing; no
    items, no change; an empty table gives no rows. Columns may have any names.
    """
    key = unused("found_id", docs)
    found = contamination(docs, items, id_col, text_col, words=words, percent=percent).select(F.col(id_col).alias(key)).distinct()
    return docs.join(found, F.col(id_col).cast("long") == F.col(key), "left_anti")
