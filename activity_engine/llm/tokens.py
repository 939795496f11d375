"""Token counts: batch encoding in Arrow functions that return lengths only.

A text splits safely before a space that follows a character other than white space: no pre-token of a byte-level
BPE spans such a place, and what stands on either side doesn't change the other's tokens. Long pieces also split
between a letter or digit and white space or punctuation. Short pieces are counted once and remembered, in tables that
are bounded by bytes in each worker; long ones are forgotten with the texts that hold them. Unseen pieces go to the
library in batches that are balanced by bytes. Nothing is truncated: a piece of any length is encoded whole.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BATCH_BYTES = 256 << 10
#: Pieces of more characters are split further and never remembered.
LONG_PIECE = 64
#: Bytes that a table of remembered pieces may take, and what an entry takes beside its text.
REMEMBERED_BYTES, ENTRY_BYTES = 192 << 20, 110
_UNSAFE_SPACE = re.compile(r"\s ")
# A pre-token that holds letters or digits ends with them, so one ends before each of these characters. None of them
# occurs in the special strings of the tokenizers, and both sides are characters that every Unicode version knows.
_SAFE_BREAK = re.compile("(?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[\t\n\r.,;:!?()\u3001\u3002\u300c\u300d\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f])")


def safe_pieces(text: str) -> list[str]:
    """Split at safe spaces; all pieces but the first begin after a space that belongs to them."""
    pieces = text.split(" ")
    if not text.startswith(" ") and not _UNSAFE_SPACE.search(text):
        return pieces
    out = [pieces[0]]
    for piece in pieces[1:]:
        if not out[-1] or out[-1][-1].isspace():
            out[-1] += " " + piece
        else:
            out.append(piece)
    return out


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """The pieces of a text that are encoded as they are, and those that follow a space."""
    first, *tails = safe_pieces(text)
    if len(text) <= LONG_PIECE:
        return [first], tails
    starts = []
    for i, piece in enumerate([first, *tails]):
        if len(piece) > LONG_PIECE or not i:
            head, *rest = _SAFE_BREAK.split(piece) if len(piece) > LONG_PIECE else [piece]
            starts += rest
            if i:
                tails[i - 1] = head
            else:
                starts.append(head)
    return starts, tails


def balanced(pieces: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about equal bytes; a piece that is longer than that is a batch of its own."""
    batch, size = [], 0
    for p in pieces:
        n = 4 * len(p) if not p.isascii() else len(p)
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(p)
        size += n
    if batch:
        yield batch


class Counter:
    """Counts tokens with one tokenizer file; `heads` begin a text, `tails` follow a space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tables: dict[str, dict[str, int]] = {"": {}, " ": {}}
        self.held = {"": 0, " ": 0}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.after_space = np.zeros(max(vocabulary.values()) + 1, bool)
        self.after_space[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def learn(self, pieces: set[str], lead: str) -> dict[str, int]:
        """The table with all these pieces; `forget` takes out again what may not stay."""
        table = self.tables[lead]
        new = sorted(pieces - table.keys())
        joined = [p for p in new if lead and p and " " not in p and not p[-1].isspace()]
        for batch in balanced(joined):
            # Encoded as one text: a piece begins at each token that begins with the space.
            ids = np.array(self.tokenizer.encode_batch_fast([lead + lead.join(batch)], add_special_tokens=False)[0].ids)
            starts = np.flatnonzero(self.after_space[ids])
            table.update(zip(batch, np.diff(starts, append=len(ids)).tolist(), strict=True))
        for batch in balanced([p for p in new if p not in table]):
            for p, e in zip(batch, self.tokenizer.encode_batch_fast([lead + p for p in batch], add_special_tokens=False), strict=True):
                table[p] = len(e)
        self.held[lead] += sum(map(sys.getsizeof, new)) + ENTRY_BYTES * len(new)
        return table

    def forget(self, pieces: set[str], lead: str) -> None:
        table = self.tables[lead]
        for p in pieces:
            if len(p) > LONG_PIECE and table.pop(p, None) is not None:
                self.held[lead] -= sys.getsizeof(p) + ENTRY_BYTES
        if self.held[lead] > REMEMBERED_BYTES:
            self.tables[lead], self.held[lead] = {}, 0

    def count(self, texts: list[str]) -> list[int]:
        split = [parts_of(t) for t in texts]
        starts, tails = set().union(*(s for s, _ in split)), set().union(*(t for _, t in split))
        as_is, spaced = self.learn(starts, ""), self.learn(tails, " ")
        out = [sum(map(as_is.__getitem__, s)) + sum(map(spaced.__getitem__, t)) for s, t in split]
        self.forget(starts, "")
        self.forget(tails, " ")
        return out


#: One for each file in each worker process: later tasks of the worker find the tokenizer loaded and pieces counted.
_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = counter_of(path)
        for batch in batches:
            for part in slices(batch):
                texts = pa.compute.fill_null(part.column(1), "")
                n = counter.count(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.compute.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64())], ["id", "b", "n"])

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Return (doc id, n_bytes, n_tokens, over_limit), one row per input row, in no fixed order.

    Tokens are what `tokenizers` gives for the file, without added special tokens, truncation or padding; the file is
    read by every worker, so it must be installed there. A null text counts as empty: 0 bytes, 0 tokens. Null ids,
    repeated rows and other columns are allowed; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = base.mapInArrow(_counter(tokenizer_path), "id long, b long, n long")
    return out.select(F.col("id").alias(id_col), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
