"""Approximate nearest neighbours: a forest of random-projection trees and one priority queue.

A tree halves vectors by random hyperplanes at the median until a node has few of them. A query walks
all trees of a forest through one shared queue, always opening the node whose plane is nearest to it among
those not yet opened, until the leaves it has reached hold so many vectors that ``goal`` of the true
neighbours of some of the forest's own vectors are met that way (clustered vectors need few leaves; for
vectors without any structure no tree helps much, and a fixed share is searched). The vectors of all
these leaves are then ranked by their exact cosines.

The table is searched in two levels, so that each vector is sent to one task only. A first tree, fitted on
a bounded sample, cuts the table into cells; a query goes to the cells that the queue reaches. A cell, or a
share of one that has many vectors, then has a forest of its own, grown and searched in one task. The
best few of each are merged by query. Queries stream past the forest of a share in batches, so memory
holds one share, whatever the number of queries.

Equal vectors have equal cosines, so of a class of equal vectors only the ``k + 1`` smallest identifiers
can be in any answer, and only those go on (an exact reduction).

Defined results: identifiers are whole numbers or text of their digits, and other text stops the job with Spark's
cast error; vectors that are null, all zero, or hold a null or a component that is not finite take
no part, as query or candidate; vectors of different lengths have no cosine and are searched apart, each
length with all its vectors; ties go to the smaller identifier; rows without an identifier are left out;
of rows that repeat an identifier with different vectors each is a candidate of its own, and the
identifier is listed once, at its best; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Trees of a share's forest, vectors of a leaf, vectors of the sample that cuts the table into cells.
TREES = 16
LEAF = 64
SAMPLE = 20_000
#: Share of true neighbours that a search must meet among the vectors that it is set by, on each level.
GOAL = 0.985
#: Vectors of a cell, and most vectors of a share.
SHARE = 8_192

_CELLS = "length int, cell int, h long, ids array<long>, vector array<double>"
_ASKED = "length int, cell int, query_id long, vector array<double>"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


class Tree:
    """One tree as arrays: node i has a plane, an offset, and children left[i] and right[i]; a negative child -1 - j is leaf j."""

    def __init__(self, points: np.ndarray, leaf: int, rng: np.random.Generator):
        self.plane, self.offset, self.left, self.right, self.weight, self.rows = [], [], [], [], [], []
        self.root = self._grow(points, np.arange(len(points)), leaf, rng)
        self.plane = np.asarray(self.plane, np.float32).reshape(len(self.offset), points.shape[1])

    def _grow(self, points, rows, leaf, rng) -> int:
        """The node over some rows of points; rows of leaf j are self.rows[j]."""
        if len(rows) > leaf:
            a, b = points[rng.choice(rows, 2, replace=False)]
            plane = (a - b).astype(np.float32)
            side = points[rows] @ plane
            cut = float(np.median(side))
            low = side <= cut
            if 0 < low.sum() < len(rows):
                node = len(self.offset)
                for held, x in ((self.plane, plane), (self.offset, cut), (self.left, 0), (self.right, 0)):
                    held.append(x)
                self.left[node] = self._grow(points, rows[low], leaf, rng)
                self.right[node] = self._grow(points, rows[~low], leaf, rng)
                return node
        self.weight.append(len(rows))
        self.rows.append(rows)
        return -len(self.weight)

    def planes_only(self) -> Tree:
        """The tree without the rows it was grown on."""
        self.rows = []
        return self

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        at = np.full(len(vectors), self.root)
        left, right, offset = np.asarray(self.left, int), np.asarray(self.right, int), np.asarray(self.offset)
        while len(inner := np.flatnonzero(at >= 0)):
            node = at[inner]
            low = np.einsum("ij,ij->i", vectors[inner], self.plane[node]) <= offset[node]
            at[inner] = np.where(low, left[node], right[node])
        return -1 - at


def grow(points: np.ndarray, trees: int, leaf: int, seed: int) -> list[Tree]:
    return [Tree(points, leaf, np.random.default_rng([seed, t])) for t in range(trees)]


def probe(forest: list[Tree], vector: np.ndarray, search: float) -> list[tuple[int, int]]:
    """(tree, leaf) pairs for a query, the most promising first, until they weigh ``search``."""
    queue = [(0.0, t, tree.root) for t, tree in enumerate(forest)]
    sides = [tree.plane @ vector - np.asarray(tree.offset, np.float32) if len(tree.offset) else None for tree in forest]
    out, held = [], 0
    while queue and held < search:
        far, t, node = heapq.heappop(queue)
        tree = forest[t]
        while node >= 0:
            side = float(sides[t][node])
            near, other = (tree.left[node], tree.right[node]) if side <= 0 else (tree.right[node], tree.left[node])
            heapq.heappush(queue, (max(far, abs(side)), t, other))
            node = near
        out.append((t, -1 - node))
        held += tree.weight[-1 - node]
    return out


def units(vectors) -> np.ndarray:
    """Vectors of length one, in single precision: trees need no more."""
    plain = np.asarray(list(vectors), np.float64)
    most = np.abs(plain).max(axis=1, keepdims=True) if plain.size else 1.0
    plain = plain / most
    return (plain / np.sqrt((plain**2).sum(axis=1, keepdims=True))).astype(np.float32)


def _by_length(pdf: pd.DataFrame):
    lengths = pdf["vector"].map(len).to_numpy()
    for n in np.unique(lengths):
        yield int(n), pdf[lengths == n]


def _assign(cells):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = cells.value
        for pdf in batches:
            for n, part in _by_length(pdf):
                cell = trees[n][0].leaves(units(part["vector"])).astype(np.int32) if n in trees else np.int32(0)
                yield part.assign(length=np.int32(n), cell=cell)[["length", "cell", "h", "ids", "vector"]]

    return run


def _probe(cells):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = cells.value
        for pdf in batches:
            found: list[tuple] = []
            for n, part in _by_length(pdf):
                for query_id, vector, unit in zip(part["query_id"], part["vector"], units(part["vector"]), strict=True):
                    found += [(n, leaf, query_id, vector) for _, leaf in (probe([trees[n][0]], unit, trees[n][1]) if n in trees else [(0, 0)])]
            yield pd.DataFrame(found, columns=["length", "cell", "query_id", "vector"])

    return run


def calibrate(forest: list[Tree], points: np.ndarray, k: int, goal: float, rng: np.random.Generator, queries: int = 100) -> float:
    """The weight of leaves after which ``goal`` of the true neighbours of some of the points have been met."""
    if len(points) <= k + 1:
        return float("inf")
    leaf_of = [tree.leaves(points) for tree in forest]
    needed = []
    for q in rng.choice(len(points), min(queries, len(points)), replace=False):
        near = points @ points[q]
        near[q] = -np.inf
        true = np.argpartition(near, -k)[-k:]
        left = {int(j) for j in true}
        held = 0
        for t, leaf in probe(forest, points[q], float("inf")):
            held += forest[t].weight[leaf]
            found = {j for j in left if leaf_of[t][j] == leaf}
            needed += [held] * len(found)
            left -= found
            if not left:
                break
    return float(np.quantile(needed, goal))


def scaled(vectors) -> np.ndarray:
    """Vectors brought near one by powers of two, which changes no digit of theirs and no cosine, so that no square over- or underflows."""
    plain = np.asarray(list(vectors), np.float64)
    return np.ldexp(plain, -np.frexp(np.abs(plain).max(axis=1, keepdims=True))[1]) if plain.size else plain


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The cosine of each row with the query in double precision, components added in order; of scaled vectors."""
    dot, qq, rr = np.zeros(len(rows)), 0.0, np.zeros(len(rows))
    for d in range(len(query)):
        dot += query[d] * rows[:, d]
        qq += query[d] ** 2
        rr += rows[:, d] ** 2
    return dot / (np.sqrt(qq) * np.sqrt(rr))


def best(rough: np.ndarray, queries: np.ndarray, rows: np.ndarray, query_ids, id_lists, k: int) -> list[tuple]:
    """(query_id, vec_id, score): for each query the k best, ties to the smaller identifier, its own left out.

    rough has the cosines in single precision; whatever may be among the best is measured exactly.
    """
    out = []
    keep = min(k + 1, rough.shape[1])
    if not keep:
        return out
    for q, vector, row in zip(query_ids, queries, rough, strict=True):
        near = np.flatnonzero(row >= np.partition(row, -keep)[-keep] - 1e-5)
        found = sorted((-s, int(i)) for j, s in zip(near, cosines(vector, rows[near]), strict=True) for i in id_lists[j] if i != q)
        seen: set[int] = set()
        for s, i in found:
            if i not in seen:
                seen.add(i)
                out.append((q, i, -s))
                if len(seen) == k:
                    break
    return out


class Share:
    """The vectors of one share, with their forest."""

    def __init__(self, rows: pd.DataFrame, k: int, trees: int, leaf: int, goal: float, seed: list[int]):
        self.k, self.ids, self.have = k, list(rows["ids"]), scaled(rows["vector"])
        self.points = units(self.have)
        self.forest = [Tree(self.points, leaf, np.random.default_rng([*seed, t])) for t in range(trees)]
        self.search = calibrate(self.forest, self.points, k, goal, np.random.default_rng(seed), queries=32)

    def candidates(self, unit: np.ndarray) -> np.ndarray:
        met = np.zeros(len(self.have), bool)
        for t, leaf in probe(self.forest, unit, self.search):
            met[self.forest[t].rows[leaf]] = True
        return np.flatnonzero(met)

    def ask(self, query_ids: list[int], vectors) -> list[tuple]:
        out = []
        for q, vector, unit in zip(query_ids, scaled(vectors), units(vectors), strict=True):
            near = self.candidates(unit)
            rough = (self.points[near] @ unit)[None, :]
            out += best(rough, vector[None, :], self.have[near], [q], [self.ids[j] for j in near], self.k)
        return out


def _meet(k: int, trees: int, leaf: int, goal: float, seed: int):
    """The best of each share for its queries; rows are sorted by share, with the share's vectors before its queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, share = None, [], None
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[["length", "cell", "share", "query"]].to_numpy(np.int64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(pdf)]
            found: list[tuple] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part, now = pdf.iloc[a:b], keys[a, :3].tolist()
                if now != key:
                    key, held, share = now, [], None
                if not keys[a, 3]:
                    held.append(part[["ids", "vector"]])
                elif held or share:
                    if share is None:
                        share, held = Share(pd.concat(held), k, trees, leaf, goal, [seed, *key]), []
                    found += share.ask(part["query_id"].astype("int64").tolist(), list(part["vector"]))
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, goal: float = GOAL, share: int = SHARE, seed: int = 9) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of queries, by cosine.

    A query's own identifier is no candidate of its.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(F.col("id").isNotNull() & usable("vector"))
    # classes of equal vectors with their smallest identifiers; -0.0 counts as 0.0
    rows = pick(vectors).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    several = rows.groupBy("vector", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"))
    classes = stage(several.groupBy("vector").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")).withColumn("h", F.abs(F.xxhash64("vector") % (1 << 40))))
    total = classes.count()
    fitted = classes.orderBy("h", "vector").limit(sample).select("vector").toPandas()
    cells = {}
    for n, part in _by_length(fitted):
        points = units(part["vector"])
        # cells of the whole table; the sample's are as much smaller as it is
        tree = Tree(points, max(4, int(share * len(fitted) / total)), np.random.default_rng([seed, n])).planes_only()
        cells[n] = (tree, calibrate([tree], points, k, goal, np.random.default_rng([seed, n])))
    sent = spark.sparkContext.broadcast(cells)
    index = stage(classes.mapInPandas(_assign(sent), _CELLS))
    shares = index.groupBy("length", "cell").agg(F.ceil(F.count(F.lit(1)) / share).cast("long").alias("shares"))
    dealt = index.join(shares, ["length", "cell"]).select("length", "cell", F.pmod("h", F.col("shares")).alias("share"), F.lit(0).alias("query"), F.lit(None).cast("long").alias("query_id"), "h", "ids", "vector")
    asked = pick(queries).withColumnRenamed("id", "query_id").mapInPandas(_probe(sent), _ASKED).join(shares, ["length", "cell"])
    asked = asked.select("length", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(1).alias("query"), "query_id", F.lit(0).cast("long").alias("h"), F.lit(None).cast("array<long>").alias("ids"), "vector")
    both = dealt.unionByName(asked).repartition("length", "cell", "share").sortWithinPartitions("length", "cell", "share", "query", "h", "query_id")
    met = both.mapInPandas(_meet(k, trees, leaf, goal, seed), "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
