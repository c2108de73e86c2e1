"""Merkle manifest of a table, with proofs for many leaves at once (octopus multiproof).

Every row is a leaf, the hash of some of its columns. The leaves of a group form a
tree in ascending order of their key, and the roots of the groups form the tree
above, groups in ascending order, null first. Two consecutive nodes become the
hash of their hex digests; a last node without partner is hashed alone.

Trees grow in tiers of blocks: a task turns an aligned block of 2**BITS nodes into
its levels above, and the blocks' tops are the next tier's nodes, so no task or
group holds more than a block whatever the size of a tree.

Proofs are made per block of leaves. From the places of the leaves alone the block
works out which nodes its leaves need and cannot derive from one another, the least
union over all of them. These coordinates are fetched by one join, the interior
nodes are derived from leaves and fetched nodes once, and the proof of each leaf is
read off them.

Rows: a null field is hashed as ``-``; a null key comes first, equal keys follow in
order of their leaf, rows equal in all fields are leaves of their own next to each
other; null is a group of its own; an empty table has no leaves; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.keys import row_index
from .store import written

BITS = 12
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, level int, place long, digest string, size long"


@dataclass(frozen=True)
class Manifest:
    """Leaves (key, tree, place, size, trees, leaf, claimed) and nodes (tree, level, place, digest)."""

    leaves: DataFrame
    nodes: DataFrame


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", claimed: Column | None = None) -> Manifest:
    """Leaves of all rows and the nodes above them.

    ``claimed`` is the leaf that a verifier is shown for a row, by default its own.
    """
    own = leaf_of([F.col(f) for f in fields])
    rows = docs.select(
        F.col(key).cast("long").alias("key"),
        F.coalesce(F.col(group), F.lit("")).alias("name"),
        F.col(group).isNotNull().alias("named"),
        own.alias("leaf"),
        (own if claimed is None else claimed).alias("claimed"),
    )
    leaves = written(_placed(written(rows, "digests")), "leaves")
    largest = leaves.agg(F.max("size").alias("size"), F.max("trees").alias("trees")).first()
    base = leaves.select("tree", F.lit(0).alias("level"), F.col("place"), F.col("leaf").alias("digest"), "size")
    below = _tiers(base, largest["size"] or 0)
    roots = below.where("size = 1").select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("place"), "digest")
    top = _tiers(roots.withColumn("size", F.lit(largest["trees"] or 0).cast("long")), largest["trees"] or 0)
    return Manifest(leaves, below.unionAll(top).drop("size"))


def _placed(rows: DataFrame) -> DataFrame:
    """Numbers the rows inside their tree and the trees.

    Ranges of (group, key) split a large group; each range is numbered by itself and
    starts where the ranges before it end. Rows equal in all fields are told apart by
    their place in the input, so that a range boundary may fall between them.
    """
    order = ["named", "name", "key", "leaf", "nth"]
    ranged = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("slice", F.spark_partition_id())
    ranged = written(ranged.drop("nth"), "ranges")
    tree = ["named", "name"]
    parts = ranged.groupBy("slice", *tree).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*tree)
    earlier = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("slice", *tree, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("size"))
    names = parts.select(*tree).distinct()
    trees = row_index(names.withColumn("order", F.struct(*tree)), "order", "tree")
    starts = starts.join(trees, tree).withColumn("trees", F.lit(names.count()).cast("long"))
    inside = F.row_number().over(Window.partitionBy("slice", *tree).orderBy("key", "leaf")) - 1
    joined = ranged.withColumn("inside", inside).join(starts, ["slice", *tree])
    place = (F.col("inside") + F.col("before")).cast("long").alias("place")
    return joined.select("key", F.col("tree").cast("long").alias("tree"), place, "size", "trees", "leaf", "claimed")


def _tiers(base: DataFrame, size: int) -> DataFrame:
    """The nodes of level 0 and all levels above; one grouped pass per 2**BITS-fold of the size."""
    tiers, level = [base], 0
    while size > 1:
        block = F.shiftright("place", BITS).alias("block")
        raised = written(tiers[-1].where((F.col("level") == level) & (F.col("size") > 1)).groupBy("tree", block).applyInArrow(_climb, NODE), "nodes")
        tiers.append(raised)
        level, size = level + BITS, -(-size >> BITS)
    return reduce(DataFrame.unionAll, tiers)


def hashed(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _climb(rows: pa.Table) -> pa.Table:
    """Up to BITS levels above an aligned block of nodes."""
    rows = rows.sort_by("place")
    tree, level, first, size = (rows.column(c)[0].as_py() for c in ("tree", "level", "place", "size"))
    digests = rows.column("digest").to_pylist()
    out = []
    for _ in range(BITS):
        if size == 1:
            break
        digests = [hashed(*digests[i : i + 2]) for i in range(0, len(digests), 2)]
        level, first, size = level + 1, first >> 1, (size + 1) >> 1
        n = len(digests)
        columns = [np.full(n, tree), np.full(n, level, np.int32), first + np.arange(n), digests, np.full(n, size)]
        out.append(pa.table([pa.array(c) for c in columns], names=["tree", "level", "place", "digest", "size"]))
    return pa.concat_tables(out)


def levels_above(known: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level below the root: the places known there, and their siblings that are not."""
    out = []
    known = np.unique(known)
    while size > 1:
        beside = known ^ 1
        out.append((known, np.setdiff1d(beside[beside < size], known)))
        known, size = np.unique(known >> 1), (size + 1) >> 1
    return out


def _paths(rows: pa.Table) -> list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Levels of the block's own tree and of the tree of groups."""
    tree, size, trees = (rows.column(c)[0].as_py() for c in ("tree", "size", "trees"))
    return [(tree, levels_above(rows.column("place").to_numpy(), size)), (TOP, levels_above(np.array([tree]), trees))]


def _lacking(rows: pa.Table) -> pa.Table:
    """Coordinates of the nodes that a block of leaves has to fetch."""
    tree, block = rows.column("tree")[0].as_py(), rows.column("block")[0].as_py()
    at, level, place = [], [], []
    for where, levels in _paths(rows):
        for n, (_, missing) in enumerate(levels):
            at += [where] * len(missing)
            level += [n] * len(missing)
            place += missing.tolist()
    columns = [pa.array([tree] * len(at), pa.int64()), pa.array([block] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(level, pa.int32()), pa.array(place, pa.int64())]
    return pa.table(columns, names=["tree", "block", "at", "level", "place"])


def _derive(levels: list[tuple[np.ndarray, np.ndarray]], base: dict[int, str], fetched: dict[int, dict[int, str]]) -> tuple[list[dict[int, str]], str]:
    """Digests by level and place, of known and fetched nodes, and the root."""
    held, now = [], base
    for n, (known, _) in enumerate(levels):
        here = now | fetched.get(n, {})
        held.append(here)
        now = {p: hashed(here[2 * p], here[2 * p + 1]) if 2 * p + 1 in here else hashed(here[2 * p]) for p in np.unique(known >> 1).tolist()}
    return held, next(iter(now.values()))


def _suffixes(levels: list, held: list[dict[int, str]], above: list[str]) -> dict[int, list[str]]:
    """Siblings from each known place of level 0 to the top, then those ``above``; shared from the top down."""
    tails = {0: above}
    for (known, _), here in zip(reversed(levels), reversed(held)):
        tails = {p: ([here[p ^ 1]] if p ^ 1 in here else []) + tails[p >> 1] for p in known.tolist()}
    return tails


def fold(leaf: str, proof: Sequence[str], *steps: tuple[int, int]) -> str:
    """The root that a leaf and its siblings lead to; ``steps`` are (place, size) in each tree on the way."""
    digest, siblings = leaf, iter(proof)
    for place, size in steps:
        while size > 1:
            if place ^ 1 < size:
                other = next(siblings)
                digest = hashed(other, digest) if place & 1 else hashed(digest, other)
            else:
                digest = hashed(digest)
            place, size = place >> 1, (size + 1) >> 1
    return digest


PROOF = "key long, leaf string, proof array<string>, subroot string, root string, folded_root string"


def _expand(rows: pa.Table, fetched: pa.Table) -> pa.Table:
    """Proof of each leaf of a block, roots as derived, and the root that its claimed leaf leads to."""
    met: dict[int, dict[int, dict[int, str]]] = {}
    for at, level, place, digest in zip(*(fetched.column(c).to_pylist() for c in ("at", "level", "place", "digest"))):
        met.setdefault(at, {}).setdefault(level, {})[place] = digest
    (tree, own), (_, above) = _paths(rows)
    places, leaves = rows.column("place").to_pylist(), rows.column("leaf").to_pylist()
    size, trees = rows.column("size")[0].as_py(), rows.column("trees")[0].as_py()
    held, subroot = _derive(own, dict(zip(places, leaves)), met.get(tree, {}))
    held_above, root = _derive(above, {tree: subroot}, met.get(TOP, {}))
    # without levels the tree's one node, whatever its place, is the root
    top = _suffixes(above, held_above, []).get(tree if above else 0)
    proofs = _suffixes(own, held, top)
    proof = [proofs[p] for p in places]
    folded = [fold(c, s, (p, size), (tree, trees)) for c, s, p in zip(rows.column("claimed").to_pylist(), proof, places)]
    n = len(places)
    columns = [rows.column("key"), rows.column("leaf"), pa.array(proof, pa.list_(pa.string())), pa.array([subroot] * n), pa.array([root] * n), pa.array(folded, pa.string())]
    return pa.table(columns, names=["key", "leaf", "proof", "subroot", "root", "folded_root"])


def prove(tree: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """(key, leaf, proof, subroot, root, folded_root) of the wanted leaves, by default of all.

    ``wanted`` are rows of ``tree.leaves``. ``proof`` lists the siblings from the leaf up.
    """
    blocked = (tree.leaves if wanted is None else wanted).withColumn("block", F.shiftright("place", BITS))
    slim = blocked.select("tree", "block", "place", "size", "trees")
    # written, so that the join can split nodes near the root, which all blocks ask for
    lacking = written(slim.groupBy("tree", "block").applyInArrow(_lacking, "tree long, block long, at long, level int, place long"), "coordinates")
    nodes = tree.nodes.withColumnRenamed("tree", "at")
    fetched = lacking.join(nodes, ["at", "level", "place"]).select("tree", "block", "at", "level", "place", "digest")
    return blocked.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(_expand, PROOF)
