"""Merkle manifest of a dataset: trees of digests in van Emde Boas order, proofs and their verification.

Every row is a leaf; the rows of a language ascend by identifier and make a tree in which eight consecutive nodes have
one parent; the languages' roots make the tree that has the manifest's root. A tree is cut at half its height, time
after time, and each part is stored together, its upper half first: ``address`` gives the place of a node from its level
and index alone, and both the construction and the search of siblings go by it. The parts that Spark deals to tasks
are aligned subtrees of BLOCK leaves; the roots of a tier's blocks are the leaves of the next tier, so what is in one
task has a fixed size however many rows there are. Proofs go the other way, from the last tier down: a block hands
each of its leaves the siblings above it.

Defined results: a null value of a column hashes as ``-``; rows without an identifier come first; rows that share an
identifier ascend by their leaf's digest, and equal rows are leaves of their own; a null language is a tree of its own
before the others; an empty table has no leaves and no root; columns that are not hashed are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

ARITY = 8

#: Levels between the leaves of a block and its root, and the leaves of a block.
DEPTH = 4
BLOCK = ARITY**DEPTH

#: What a leaf hashes, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def nodes_of(levels: int) -> int:
    """Nodes of a whole tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(level: int, index, levels: int):
    """Place in van Emde Boas order of the node (or array of nodes) at a level, the root's being 0, of a tree of so many levels."""
    at = 0 * index
    while levels > 1:
        top = levels // 2
        if level < top:
            levels = top
        else:
            level, levels = level - top, levels - top
            tree, index = index // ARITY**level, index % ARITY**level
            at = at + nodes_of(top) + tree * nodes_of(levels)
    return at


@cache
def _addresses(level: int, levels: int) -> np.ndarray:
    return address(level, np.arange(ARITY**level), levels)


def levels_of(leaves: int, whole: bool) -> int:
    """Levels of a block: a tree that is one block is as low as its leaves allow, one of several blocks has all levels."""
    levels = 1
    while ARITY ** (levels - 1) < leaves:
        levels += 1
    return levels if whole else DEPTH + 1


def lay_out(leaves: list[bytes], levels: int) -> np.ndarray:
    """The digests of a subtree, 32 bytes each, at their addresses; places without a node are zero."""
    nodes = np.zeros((nodes_of(levels), 32), np.uint8)
    count = len(leaves)
    nodes[_addresses(levels - 1, levels)[:count]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32)
    for level in range(levels - 2, -1, -1):
        below, own = _addresses(level + 1, levels)[:count], _addresses(level, levels)
        for k, first in enumerate(range(0, count, ARITY)):
            nodes[own[k]] = np.frombuffer(sha256(nodes[below[first : first + ARITY]].tobytes().hex().encode()).digest(), np.uint8)
        count = -(-count // ARITY)
    return nodes


Path = tuple[tuple[bytes, bytes], ...]  # siblings to the left and to the right, hexadecimal, a level each, the lowest first


def paths(nodes: np.ndarray, leaves: int, levels: int, above: Path) -> list[Path]:
    """The siblings that each leaf of a block meets on its way to the root, found by address."""
    counts = [leaves]
    for _ in range(levels - 1):
        counts.append(-(-counts[-1] // ARITY))
    held = [above]
    for level in range(1, levels):
        count, at = counts[levels - 1 - level], _addresses(level, levels)
        below = []
        for k, path in enumerate(held):
            run = nodes[at[ARITY * k : min(ARITY * k + ARITY, count)]].tobytes().hex().encode()
            below += [((run[: 64 * i], run[64 * i + 64 :]), *path) for i in range(len(run) // 64)]
        held = below
    return held


def fold(leaf: str, path: Path) -> str:
    """The root that a leaf's digest and its siblings give."""
    for left, right in path:
        leaf = sha256(left + leaf.encode() + right).hexdigest()
    return leaf


@dataclass(frozen=True)
class Manifest:
    """leaves: tree, pos, n, id, leaf and what was kept; tiers: blocks of the languages' trees, the lowest first; trees: the leaves of the tree over their roots, id being the tree's name; top: its tiers; root: the whole digest, None without leaves.

    A block: tree, n (leaves of the tree in this tier), block, leaves, nodes (digests in van Emde Boas order), root.
    """

    leaves: DataFrame
    tiers: list[DataFrame]
    trees: DataFrame
    top: list[DataFrame]
    root: str | None


def leaf_digest(columns: dict[str, Column]) -> Column:
    """Digest of a row, hexadecimal: each value after its length in bytes."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns.values()]
    return F.sha2(F.concat(*parts), 256)


def number(rows: DataFrame) -> DataFrame:
    """rows (tree, id, leaf, ...) with pos, their place in their tree by id and leaf, and n, the tree's leaves.

    Rows are dealt by ranges of the order, so that a tree that holds most of them lies in many tasks; the counts of the ranges say where each begins.
    """
    tie = "__tie"
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange("tree", F.col("id").asc_nulls_first(), "leaf", tie)
    placed = stage(dealt.sortWithinPartitions("tree", F.col("id").asc_nulls_first(), "leaf").drop(tie).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy("tree", "__part").agg(F.count(F.lit(1)).alias("__k"), F.min("__at").alias("__first"))
    of_tree = Window.partitionBy("tree")  # a row for each range: as many as there are tasks at most
    before = F.coalesce(F.sum("__k").over(of_tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__k").over(of_tree).alias("n"))
    return placed.join(counts, ["tree", "__part"]).withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def _block_of(pos: Column | str) -> Column:
    return F.shiftright(pos, BLOCK.bit_length() - 1)


_BLOCKS = "tree string, n long, block long, leaves int, nodes binary, root string"


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    tree, n, pos = pdf["tree"].iloc[0], int(pdf["n"].iloc[0]), int(pdf["pos"].iloc[0])
    nodes = lay_out([bytes.fromhex(x) for x in pdf["leaf"]], levels_of(len(pdf), n <= BLOCK))
    return pd.DataFrame([(tree, n, pos // BLOCK, len(pdf), nodes.tobytes(), nodes[0].tobytes().hex())], columns=["tree", "n", "block", "leaves", "nodes", "root"])


def build_tiers(leaves: DataFrame) -> list[DataFrame]:
    """Blocks of every tree, tier by tier: the roots of one tier's blocks are the next one's leaves. leaves: tree, pos, n, leaf."""
    tiers, rows = [], leaves.select("tree", "pos", "n", "leaf")
    while True:
        tiers.append(stage(rows.groupBy("tree", _block_of("pos")).applyInPandas(_block, _BLOCKS)))
        more = tiers[-1].filter(F.col("n") > BLOCK)
        if not more.limit(1).count():
            return tiers
        rows = more.select("tree", F.col("block").alias("pos"), _block_of(F.col("n") + (BLOCK - 1)).alias("n"), F.col("root").alias("leaf"))


def subroots(tiers: list[DataFrame]) -> DataFrame:
    """(tree, root): the only block of a tree in its last tier."""
    out = None
    for tier in tiers:
        last = tier.filter(F.col("n") <= BLOCK).select("tree", "root")
        out = last if out is None else out.unionByName(last)
    return out


def build_manifest(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", columns: tuple[str, ...] = COLUMNS, keep: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table: its leaves, and the trees over them. keep: more columns for the leaves."""
    leaf = leaf_digest({c: F.col(c) for c in columns})
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(lang_col)), F.lit("")).alias("tree"), F.col(id_col).alias("id"), leaf.alias("leaf"), *[c.alias(n) for n, c in (keep or {}).items()])
    leaves = stage(number(stage(rows)))
    tiers = build_tiers(leaves)
    trees = stage(number(stage(subroots(tiers).select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("root").alias("leaf")))))
    top = build_tiers(trees)
    whole = subroots(top).first()
    return Manifest(leaves, tiers, trees, top, whole and whole["root"])


_PATH = "lefts array<binary>, rights array<binary>"


def _hand_down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            levels = levels_of(r.leaves, r.n <= BLOCK)
            found = paths(np.frombuffer(r.nodes, np.uint8).reshape(-1, 32), r.leaves, levels, tuple(zip(r.lefts, r.rights, strict=True)))
            yield pd.DataFrame({"tree": r.tree, "block": range(r.block * BLOCK, r.block * BLOCK + r.leaves), "lefts": [[a for a, _ in p] for p in found], "rights": [[b for _, b in p] for p in found]})


def _descend(tiers: list[DataFrame], above: DataFrame, stop: int) -> DataFrame:
    """(tree, block, lefts, rights) for the blocks of tier ``stop`` - 1, or for the leaves if it is 0; above: the same for the one block of each tree's last tier."""
    held = None
    for k in range(len(tiers) - 1, stop - 1, -1):
        ends = tiers[k].filter(F.col("n") <= BLOCK).select("tree", "block").join(above, "tree")
        held = ends if held is None else held.unionByName(ends)
        rows = tiers[k].join(held, ["tree", "block"]).select("tree", "n", "block", "leaves", "nodes", "lefts", "rights")
        held = stage(rows.mapInPandas(_hand_down, f"tree string, block long, {_PATH}"))
    if stop and tiers:
        ends = tiers[stop - 1].filter(F.col("n") <= BLOCK).select("tree", "block").join(above, "tree")
        held = ends if held is None else held.unionByName(ends)
    return held


_VERIFIED = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _verify(claims: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    block = next(blocks.itertuples(index=False))
    levels = levels_of(block.leaves, block.n <= BLOCK)
    nodes = np.frombuffer(block.nodes, np.uint8).reshape(-1, 32)
    found = paths(nodes, block.leaves, levels, tuple(zip(block.lefts, block.rights, strict=True)))
    own = _addresses(levels - 1, levels)
    out = []
    for pos, name, claimed in zip(claims["pos"], claims["id"], claims["claimed"], strict=True):
        at = int(pos) - block.block * BLOCK
        folded = fold(claimed, found[at])
        proof = sha256(b"".join(a + b for a, b in found[at])).hexdigest()
        out.append((name, nodes[own[at]].tobytes().hex(), block.subroot, block.root, proof, folded, folded == block.root))
    return pd.DataFrame(out, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def verify(manifest: Manifest, claims: DataFrame) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified): claims (tree, pos, id, claimed) held against the manifest.

    claimed is the digest that the row has now; it is folded with the siblings that the manifest has for its place.
    """
    kind = claims.schema["id"].dataType
    none = F.array().cast("array<binary>")
    of_tree = _descend(manifest.top, subroots(manifest.top).select("tree", none.alias("lefts"), none.alias("rights")), 0).drop("tree")
    above = stage(manifest.trees.select(F.col("id").alias("tree"), F.col("pos").alias("block"), F.col("leaf").alias("subroot")).join(of_tree, "block").drop("block"))
    held = _descend(manifest.tiers, above.drop("subroot"), 1)
    blocks = manifest.tiers[0].drop("root").join(held, ["tree", "block"]).join(above.select("tree", "subroot"), "tree").withColumn("root", F.lit(manifest.root))
    asked = claims.select("tree", "pos", _block_of("pos").alias("block"), F.col("id").cast("string").alias("id"), "claimed")  # numbers with nulls would turn to doubles on the way
    return asked.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(_verify, _VERIFIED).withColumn("id", F.col("id").cast(kind))
