"""Prefix trie of conversations: every distinct beginning is a node; subtrees are summed up by bands of depths.

1. Turns are placed by ranges, not by windows over a conversation, and cut into blocks of a few bands; a block's sums are
   added to those of the blocks before it. A node is named by 128 bits: its depth and four sums, over its turns, of 32-bit
   hashes of a turn and its place. So a conversation of any length is many tasks.
2. A node hangs in the band of the BAND depths that it ends or lies in. It explodes to its ancestors within that band only,
   whose names come from the path of its least conversation. Band by band, what lies strictly inside is summed for the band's
   top; the tops are a trie of their own, BAND times less deep, which is summed in the same way. Its totals, complete, then
   enter the bands above as one row a top. For depth D that are log(D) rounds of at most BAND rows a node.
3. Conversations that end at a node are listed in pieces of PIECE ids; pieces are hashed in order as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranking import positions
from .common import written

BAND, BLOCK, PIECE = 8, 1024, 256
_SUMS = ["s1", "s2", "s3", "s4"]
_MASK = 0xFFFFFFFF


def placed_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, n_turns, x, y, n_chars): each turn's place from 0 by turn, null first, and a hash of role and text.

    Null roles and texts are empty. Turns with equal numbers are ordered by role and then text; turns that repeat are each
    a turn. Rows with a null id belong to no conversation and are left out. Texts of any length are read whole.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), *filled).filter("conv_id IS NOT NULL")
    rows = positions(rows, ["conv_id", "turn", "role", "text"], "row", written)
    name = [F.char_length("role"), F.col("role"), F.col("text")]
    rows = written(rows.select("conv_id", "row", F.xxhash64(*name).alias("x"), F.xxhash64(*name[::-1]).alias("y"), F.char_length("text").cast("long").alias("n_chars")), "trie-turns")
    starts = written(rows.groupBy("conv_id").agg(F.min("row").alias("start"), F.count("*").alias("n_turns")), "trie-starts")
    return rows.join(starts, "conv_id").select("conv_id", (F.col("row") - F.col("start")).alias("place"), "n_turns", "x", "y", "n_chars")


def rebuilt(turns: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their group does, from `placed_turns`: (ids, turns with depth from 1).

    The first h turns of conversation c - c % group (all if there are fewer, none if it is absent), then c's own after its
    first h; h is the checksum of c's decimals modulo `heads`. ids are all conversations, also those left without turns.
    """
    turns = written(turns, "trie-own")
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % heads
    ids = turns.filter("place = 0").select("conv_id", "n_turns", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"))
    length = ids.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base"))
    plan = ids.join(length, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("n_head"))
    plan = written(plan, "trie-plan")
    first = turns.filter(F.col("place") < heads - 1).select(F.col("conv_id").alias("base"), "place", "x", "y", "n_chars")
    head = plan.join(first, "base").filter("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "x", "y", "n_chars")
    own = turns.select("conv_id", "place", "x", "y", "n_chars").join(plan.select("conv_id", "h", "n_head"), "conv_id").filter("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("n_head") + 1).alias("depth"), "x", "y", "n_chars")
    return plan.select("conv_id"), head.union(own)


def _node(depth: Column, sums: list[Column]) -> tuple[Column, Column]:
    return F.xxhash64(depth, *sums), F.xxhash64(*sums[::-1], depth)


def _paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, n_chars): the node that each turn leads to, and the node that it leaves."""
    keyed = turns.withColumns({"p": F.xxhash64("x", "y", "depth"), "q": F.xxhash64("depth", "y", "x")})
    halves = [F.shiftrightunsigned("p", 32), F.col("p").bitwiseAND(_MASK), F.shiftrightunsigned("q", 32), F.col("q").bitwiseAND(_MASK)]
    keyed = keyed.select("conv_id", "depth", "n_chars", F.floor((F.col("depth") - 1) / BLOCK).alias("block"), *[h.alias(s) for h, s in zip(halves, _SUMS, strict=True)])
    keyed = written(keyed, "trie-keyed")
    blocks = keyed.groupBy("conv_id", "block").agg(*[F.sum(s).alias(s) for s in _SUMS])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for BLOCK turns
    blocks = written(blocks.select("conv_id", "block", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"t{s}") for s in _SUMS]).filter("block > 0"), "trie-blocks")
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = keyed.withColumns({f"r{s}": F.sum(s).over(within) for s in _SUMS}).join(blocks, ["conv_id", "block"], "left")
    here = [F.col(f"r{s}") + F.coalesce(F.col(f"t{s}"), F.lit(0)) for s in _SUMS]
    (a, b), (pa_, pb) = _node(F.col("depth"), here), _node(F.col("depth") - 1, [x - F.col(s) for x, s in zip(here, _SUMS, strict=True)])
    return written(run.select("conv_id", "depth", a.alias("a"), b.alias("b"), pa_.alias("pa"), pb.alias("pb"), "n_chars"), "trie-paths")


def _bands(paths: DataFrame) -> DataFrame:
    """(conv_id, band, top, ids): the names on a path in each band of BAND depths, below its top."""
    here = F.sort_array(F.collect_list(F.struct("depth", "a", "b", "pa", "pb")))
    g = paths.groupBy("conv_id", F.floor((F.col("depth") - 1) / BAND).alias("band")).agg(here.alias("s"))
    top = F.struct(F.col("s")[0]["pa"].alias("a"), F.col("s")[0]["pb"].alias("b"))
    return g.select("conv_id", "band", top.alias("top"), F.transform("s", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("ids"))


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str]) -> DataFrame:
    """(a, b, *values): the values of `nodes` (depth, a, b, conv_id, *values) summed over each node's subtree.

    paths (conv_id, depth, a, b, pa, pb) has at least the path of each node's conv_id; the root has depth 0.
    """
    bands = written(_bands(paths.join(nodes.select("conv_id").distinct(), "conv_id", "left_semi")), "trie-bands")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    within = nodes.filter("depth > 0").withColumn("band", F.floor((F.col("depth") - 1) / BAND)).join(bands, ["conv_id", "band"])
    own = F.slice("ids", 1, (F.col("depth") - F.col("band") * BAND).cast("int"))
    within = written(within.select("depth", "a", "b", "top", own.alias("ids"), *values), "trie-within")
    add = [F.sum(v).alias(v) for v in values]
    inside = within.filter(F.col("depth") % BAND != 0)
    tops = nodes.filter(F.col("depth") % BAND == 0).select((F.col("depth") / BAND).cast("long").alias("depth"), "a", "b", "conv_id", *values)
    below = inside.groupBy("top.a", "top.b").agg(*[F.sum(v).alias(f"in_{v}") for v in values])
    tops = tops.join(below, ["a", "b"], "left").select("depth", "a", "b", "conv_id", *[(F.col(v) + F.coalesce(f"in_{v}", F.lit(0))).alias(v) for v in values])
    tops = written(tops, "trie-tops")
    if deepest < BAND:
        whole = tops.select("a", "b", *values)
    else:
        last = F.element_at("ids", BAND)
        up = bands.filter(F.size("ids") == BAND).select("conv_id", (F.col("band") + 1).alias("depth"), last["a"].alias("a"), last["b"].alias("b"), F.col("top.a").alias("pa"), F.col("top.b").alias("pb"))
        whole = written(subtree_sums(tops, up, values), "trie-sums")
    bottoms = within.filter(F.col("depth") % BAND == 0).select("a", "b", "ids").join(whole, ["a", "b"]).select("ids", *values)
    enter = inside.select("ids", *values).union(bottoms)
    sums = enter.select(F.explode(F.slice("ids", 1, BAND - 1)).alias("id"), *values).groupBy("id.a", "id.b").agg(*add)
    return sums.union(whole)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, piece, ids) by node and piece: the SHA-256 of each node's ids, joined by commas as they stream by."""
    at, digest, out = None, None, []
    for batch in batches:
        for a, b, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)], strict=True):
            if (a, b) != at:
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], ["a", "b", "ends_sha256"]) if out else _none()
        out = []
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, digest.hexdigest()), _TYPES, strict=True)], ["a", "b", "ends_sha256"])


_TYPES = [pa.int64(), pa.int64(), pa.string()]


def _none() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES], ["a", "b", "ends_sha256"])


def _ends(last: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the nodes where conversations end, from (a, b, conv_id)."""
    listed = positions(last, ["a", "b", "conv_id"], "row", written)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = listed.groupBy("a", "b", F.floor(F.col("row") / PIECE).alias("piece")).agg(joined.alias("ids"))
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "piece").mapInArrow(_hashed, "a long, b long, ends_sha256 string")


def prefix_trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """Return the trie of the conversations `ids` (conv_id) with `turns` (conv_id, depth from 1, x, y, n_chars).

    One row a node: conv_id (its least member), depth, parent_conv_id (of the node above; root: null), n_convs, n_children,
    n_leaves (nodes without children in its subtree, itself included), saved_tokens (over its subtree, code points of each
    node's last text times its members but one), ends_sha256 (of the ids that end there, ascending, joined by commas).
    A conversation without turns is a member of the root. Without conversations there are no rows.
    """
    paths = _paths(turns)
    zero = _node(F.lit(0).cast("long"), [F.lit(0).cast("long")] * 4)
    members = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")]
    fields = ["depth", "a", "b", "pa", "pb", "conv_id", "n_convs", "n_chars"]
    deep = paths.groupBy("depth", "a", "b").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), *members, F.min("n_chars").alias("n_chars")).select(*fields)
    none = F.lit(None).cast("long")
    root = ids.agg(*members).filter("n_convs > 0").select(F.lit(0).cast("long"), *zero, none, none, "conv_id", "n_convs", F.lit(0).cast("long"))
    nodes = written(deep.union(root), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_chars")}), "trie-nodes")
    sums = subtree_sums(nodes.select("depth", "a", "b", "conv_id", "n_leaves", "saved_tokens"), paths, ["n_leaves", "saved_tokens"])
    sums = written(sums, "trie-sums")
    # Where conversations end: at their deepest node, or at the root.
    end = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "a", "b")).alias("e"))
    last = ids.join(end, "conv_id", "left").select(F.coalesce("e.a", zero[0]).alias("a"), F.coalesce("e.b", zero[1]).alias("b"), "conv_id")
    ends = written(_ends(last), "trie-ends")
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(sums, ["a", "b"]).join(ends, ["a", "b"], "left").join(above, ["pa", "pb"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of whole conversations; ordering and nulls as in `placed_turns`, columns as in `prefix_trie`."""
    turns = written(placed_turns(conversations, id_col, turn_col, role_col, text_col).withColumn("depth", F.col("place") + 1), "trie-own")
    return prefix_trie(turns.filter("place = 0").select("conv_id"), turns)
