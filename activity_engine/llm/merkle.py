"""Merkle manifest of a dataset: a tree of digests for each value of one column, joined by a tree over these.

1. Every row is a leaf: the digest of its fields. Leaves of a tree stand in the order of an id; places come from ranges.
2. Levels are built from the leaves up, each an eighth of the one below. A node row holds its children's digests, its own,
   and the row above it with its place there; rows of all levels are one written table.
3. A recursive query climbs from each leaf: each step joins the row above, appends the other children's digests as one
   more row of the leaf's proof, and folds its own digest with them, until there is no row above. What it arrives at must
   be the root. A step's row has that step's digests alone, so that proofs don't grow from step to step.

Near the root few rows meet all leaves: both sides of that join are shuffled as they are, so that AQE can split it.
Digests travel as 32 bytes; they are hashed as hexadecimal text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import positions
from .common import lower_ascii, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 8
_TOP = -1

_CLIMB = """WITH RECURSIVE climb (leaf_no, step, id, leaf, tree, level, run, place, subroot, folded, beside) AS (
  SELECT leaf_no, 0, id, leaf, tree, level, run, place, subroot, now, X'' FROM {leaves}
  UNION ALL
  SELECT c.leaf_no, c.step + 1, CAST(NULL AS {id}), CAST(NULL AS BINARY), n.up_tree, n.up_level, n.up_run, n.up_place, n.subroot,
    unhex(sha2(lower(hex(concat(substring(n.children, 1, 32 * c.place), c.folded, substring(n.children, 32 * c.place + 33)))), 256)),
    concat(substring(n.children, 1, 32 * c.place), substring(n.children, 32 * c.place + 33))
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.level = n.level AND c.run = n.run)
SELECT leaf_no, step, id, leaf, subroot, folded, beside FROM climb LIMIT ALL"""


@dataclass(frozen=True)
class Manifest:
    """leaves (leaf_no, id, leaf, now, where the leaf hangs, subroot of a lone leaf), nodes, and the root's digest."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def hexadecimal(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row: `-` for each field that is null, else its bytes in UTF-8, `:` and its text."""
    texts = [c.cast("string") for c in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256))


def _runs(items: DataFrame) -> DataFrame:
    """Node rows over the items (tree, n, pos, digest) of trees with more than one: at most RUN children each."""
    packed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "digest"))), lambda s: hexadecimal(s["digest"]))
    runs = items.filter("n > 1").groupBy("tree", "n", F.floor(F.col("pos") / RUN).alias("run")).agg(F.array_join(packed, "").alias("text"))
    return runs.select("tree", "n", "run", F.unhex("text").alias("children"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"))


def _built(items: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All node rows over the items, level by level, and (tree, digest) of the trees' tops."""
    largest = items.agg(F.max("n")).first()[0] or 0
    levels, tops = [], [items.filter("n = 1").select("tree", "digest")]
    while largest > 1:
        runs = written(_runs(items).withColumn("level", F.lit(len(levels))), "merkle-level")
        levels.append(runs)
        items = runs.select("tree", F.ceil(F.col("n") / RUN).alias("n"), F.col("run").alias("pos"), "digest")
        tops.append(items.filter("n = 1").select("tree", "digest"))
        largest = -(-largest // RUN)
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return levels, out


def _above(n: Column, tree: Column, level: Column, pos: Column, trees: int) -> list[Column]:
    """Where an item at `pos` of `n` hangs: in its own tree, or as the top of a tree in the tree over trees; null: nowhere."""
    inner = n > 1
    top = ~inner & (tree != _TOP) & F.lit(trees > 1)

    def pick(own: Column, of_top: Column) -> Column:
        return F.when(inner, own).when(top, of_top).cast("long")

    return [
        pick(tree, F.lit(_TOP)).alias("up_tree"),
        pick(level, F.lit(0)).alias("up_level"),
        pick(F.floor(pos / RUN), F.floor(tree / RUN)).alias("up_run"),
        pick(pos % RUN, tree % RUN).cast("int").alias("up_place"),
    ]


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang", now: dict[str, Column] | None = None) -> Manifest:
    """Build the manifest of `docs`. `now` says what fields read at a later time, for `verified` to tell.

    The leaves of each value of `tree_col` are ordered by `id_col`, then by digest: rows that repeat an id each have a leaf,
    and equal rows equal ones. A null id comes first, and so does the tree of null. A null field is not an empty text.
    Texts of any length are read whole. An empty table has no leaves and no root (None). Other columns are ignored,
    whatever their names.
    """
    now = now or {}
    later = leaf_digest([now.get(f, F.col(f)) for f in fields])
    base = docs.select(F.col(tree_col).alias("value"), F.col(id_col).alias("id"), leaf_digest([F.col(f) for f in fields]).alias("leaf"), later.alias("now"))
    placed = written(positions(written(base, "merkle-leaves"), ["value", "id", "leaf", "now"], "leaf_no", written), "merkle-places")
    values = placed.groupBy("value").agg(F.min("leaf_no").alias("start"), F.count("*").alias("n"))
    values = written(positions(values, ["value"], "tree", written), "merkle-trees")
    trees = values.count()
    items = placed.join(values, placed["value"].eqNullSafe(values["value"])).select("leaf_no", "id", "leaf", "now", "tree", "n", (F.col("leaf_no") - F.col("start")).alias("pos"))
    items = written(items, "merkle-items")
    levels, tops = _built(items.select("tree", "n", "pos", F.col("leaf").alias("digest")))
    over, root = _built(tops.select(F.lit(_TOP).alias("tree"), F.lit(trees).alias("n"), F.col("tree").alias("pos"), "digest"))
    node = ["tree", "level", "run", "children"]
    rows = None
    for runs in [*levels, *over]:
        n = F.ceil(F.col("n") / RUN)
        subroot = F.when((n == 1) & (F.col("tree") != _TOP), F.col("digest")).alias("subroot")
        part = runs.select(*node, subroot, *_above(n, F.col("tree"), F.col("level") + 1, F.col("run"), trees))
        rows = part if rows is None else rows.union(part)
    spark = docs.sparkSession
    if rows is None:
        links = "up_tree long, up_level long, up_run long, up_place int"
        rows = spark.createDataFrame([], f"tree long, level long, run long, children binary, subroot binary, {links}")
    hung = _above(F.col("n"), F.col("tree"), F.lit(0), F.col("pos"), trees)
    leaves = items.select("leaf_no", "id", "leaf", "now", F.when(F.col("n") == 1, F.col("leaf")).alias("subroot"), *hung)
    for name in ("tree", "level", "run", "place"):
        leaves = leaves.withColumnRenamed(f"up_{name}", name)
    found = root.first()
    return Manifest(leaves, written(rows, "merkle-nodes"), bytes(found["digest"]).hex() if found else None)


def verified(manifest: Manifest) -> DataFrame:
    """Return (id, leaf, subroot, root, proof_sha256, folded_root, verified), one row a leaf, by the recursive climb.

    proof_sha256 is of the digests beside the leaf's way to the root, from below; a leaf that is the root has none.
    folded_root is what the leaf's present digest comes to on that way; verified says whether that is the root.
    """
    spark = manifest.leaves.sparkSession
    climbed = spark.sql(_CLIMB.replace("{id}", manifest.leaves.schema["id"].dataType.simpleString()), leaves=manifest.leaves, nodes=manifest.nodes)
    way = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "beside"))), lambda s: hexadecimal(s["beside"])), "")
    facts = [F.max(c).alias(c) for c in ("id", "leaf", "subroot")]
    climbed = climbed.groupBy("leaf_no").agg(*facts, F.max(F.struct("step", "folded"))["folded"].alias("folded"), way.alias("way"))
    root, folded = F.lit(manifest.root), hexadecimal(F.col("folded"))
    proof = F.sha2(F.encode("way", "UTF-8"), 256).alias("proof_sha256")
    return climbed.select("id", hexadecimal(F.col("leaf")).alias("leaf"), hexadecimal(F.col("subroot")).alias("subroot"), root.alias("root"), proof, folded.alias("folded_root"), (folded == root).alias("verified"))


def tampered(docs: DataFrame) -> dict[str, Column]:
    """What the check reads: texts lower-cased where the id's checksum is a multiple of 3. Null ids are left as they are."""
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    return {"text": F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text"))}
