"""Whitening of embeddings: principal components to double precision, and rows scaled to unit covariance.

Entries become whole numbers, so that counts, sums and each row's deviation are exact whatever the order of rows. The
covariance is summed over partitions from centred rows; only dimension-by-dimension matrices leave the tasks, and their
sums are made by Spark. The eigenvectors of the d x d covariance start in float32 and are corrected by Ogita and Aishima's
iterations, which are products of matrices in extended precision: from R = I - X'X and S = X'VX come new eigenvalues and
the correction of X. Where eigenvalues lie closer together than the residual can tell apart, the correction only makes
vectors orthogonal; such a cluster gets a sub-solve, the eigenvectors of the small matrix of V less the cluster's mean,
which turns the vectors within their space, and the iterations go on.

Defined results: rows whose vector is null, empty or holds null or non-finite entries take no part; vectors of another length than
the most frequent one (ties: the longest) take none either; null and repeated identifiers are rows like others; entries beyond the
range of a long are set to its ends; a component without variance (a 2^-40th of the trace or less) has no whitened value and explains 0;
a deviation that a long can't hold is null there and whole in ``deviation_digits``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: An entry c becomes floor(SCALE * c) + OFFSET. Fixed values.
SCALE, OFFSET = 1024, 100_000

#: Components without more variance than this part of the whole count as none.
NONE = 2.0**-40

_LIMIT = 2**62


@dataclass(frozen=True)
class Whitening:
    """n rows with sums of each dimension; values and vectors: eigenvalues, falling, and unit eigenvectors in columns; trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): the vectors that take part, as whole numbers; written once, since several passes follow."""
    c = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & (F.size(c) > 0)
    rows = vectors.select(F.col(id_col).alias("id"), c.alias("c")).filter(fine)
    usual = rows.groupBy(F.size("c").alias("d")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
    if usual:
        rows = rows.filter(F.size("c") == usual["d"])
    top = float(_LIMIT)
    whole = F.transform("c", lambda v: F.greatest(F.least(F.floor(F.greatest(F.least(v * SCALE, F.lit(top)), F.lit(-top))).cast("long"), F.lit(_LIMIT - OFFSET - 1)), F.lit(-_LIMIT)) + OFFSET)
    return stage(rows.select("id", whole.alias("x")))


def sums(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Rows and exact sums of each dimension: whole numbers in Spark's decimals."""
    got = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(19,0)")).alias("s")).orderBy("i").collect()
    return (got[0]["n"], tuple(int(r["s"]) for r in got)) if got else (0, ())


def centred(x: np.ndarray, n: int, total: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """n*x-S, in exact whole numbers (int64 where they fit, else Python's), and x-S/n from them, rounded once."""
    if len(x) == 0 or max(int(np.abs(x).max()) * n, max(map(abs, total))) < _LIMIT // 2:
        exact = x * n - np.array(total, np.int64)
    else:
        exact = x.astype(object) * n - np.array(total, object)
    return exact, (exact / n).astype(np.float64)


def covariance(rows: DataFrame, n: int, total: tuple[int, ...]) -> np.ndarray:
    """Covariance with divisor n: each task multiplies its centred rows, and Spark adds the tasks' products by place."""
    d = len(total)
    columns = ", ".join(f"v{j} double" for j in range(d))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                y = centred(np.stack(pdf["x"].to_numpy()), n, total)[1]
                held += y.T @ y / n
        yield pd.DataFrame(np.column_stack([np.arange(d), held]), columns=["i", *[f"v{j}" for j in range(d)]])

    parts = rows.select("x").mapInPandas(products, f"i double, {columns}")
    added = parts.groupBy("i").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(d)]).toPandas().sort_values("i")  # d rows, however many partitions
    v = added.drop(columns="i").to_numpy()
    return (v + v.T) / 2


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of eigenvalues, in order, each closer to the next than the gap; single ones are none."""
    order = np.argsort(values, kind="stable")
    runs = np.split(order, np.flatnonzero(np.diff(values[order]) > gap) + 1)
    return [r for r in runs if len(r) > 1]


def refine(v: np.ndarray, x: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a symmetric matrix from nearly right vectors, by Ogita and Aishima's iterations.

    All products are in extended precision. The gap under which two eigenvalues count as one is what the residual and the
    loss of orthogonality amount to, and the root of the precision at least, so that a quotient by it is right; a cluster is solved apart with V less its mean, so that its small differences count.
    """
    wide = np.longdouble
    v, x = v.astype(wide), x.astype(wide)
    eye = np.eye(len(v), dtype=wide)
    size = np.sqrt((v * v).sum())
    last = np.inf
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ v @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        gap = max(2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum())), size * np.sqrt(np.finfo(wide).eps))
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= gap
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
        x = x + x @ e
        for run in _clusters(values, gap):
            y = x[:, run]
            mean = values[run].mean()
            small = y.T @ (v @ y - mean * y)
            small = (small + small.T) / 2
            scale = np.abs(small).max()
            if scale > 0:
                turned = np.linalg.eigh((small / scale).astype(np.float64))[1].astype(wide)
                # the rotation is right to double precision; made orthogonal to more than that
                turned = turned @ (3 * np.eye(len(run), dtype=wide) - turned.T @ turned) / 2
                x[:, run] = y @ turned
        moved = float(np.abs(e).max())
        if moved < 1e-17 or (moved < 1e-12 and moved >= last):
            break
        last = moved
    values = np.diag(x.T @ v @ x) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))
    return values[order].astype(np.float64), x.astype(np.float64)


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors in columns: float32 first, then refined; an entry of largest size is positive."""
    scale = np.abs(v).max()
    if not scale > 0:
        return np.zeros(len(v)), np.eye(len(v))
    rough = np.linalg.eigh((v / scale).astype(np.float32))[1]
    values, x = refine(v / scale, rough)
    return values * scale, x * np.where(x[np.abs(x).argmax(0), np.arange(len(v))] < 0, -1, 1)


def fit(rows: DataFrame) -> Whitening:
    """The whitening of what ``whole_numbers`` gives. The driver holds d x d matrices."""
    n, total = sums(rows)
    if not n:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    v = covariance(rows, n, total)
    return Whitening(n, total, *eigenvectors(v), float(np.trace(v)))


def transform(rows: DataFrame, model: Whitening, components: int = 8) -> DataFrame:
    """(id, deviation_digits, whitened): for each row the exact sum of squares of n*x-S, as digits, and its values on the first components."""
    n, total = model.n, model.sums
    k = min(components, len(total))
    held = model.values[:k] > NONE * model.trace
    scale = np.where(held, np.sqrt(np.where(held, model.values[:k], 1)), np.nan)
    vectors = model.vectors[:, :k]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                exact, y = centred(np.stack(pdf["x"].to_numpy()), n, total)
                if exact.dtype != object and float(np.abs(exact).max()) ** 2 * len(total) >= _LIMIT:
                    exact = exact.astype(object)
                yield pd.DataFrame({"id": pdf["id"], "deviation_digits": (exact * exact).sum(1).astype(str), "whitened": list(y @ vectors / scale)})

    # numbers with nulls would turn to doubles on the way
    text = rows.select(F.col("id").cast("string").alias("id"), "x")
    return text.mapInPandas(apply, "id string, deviation_digits string, whitened array<double>").withColumn("id", F.col("id").cast(rows.schema["id"].dataType))


def identity_error(whitened: DataFrame, n: int, k: int) -> float | None:
    """Largest entry of the whitened rows' covariance less the identity; None where no component has variance."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = np.zeros(k), np.zeros((k, k))
        for pdf in batches:
            if len(pdf):
                w = np.stack(pdf["whitened"].to_numpy())
                first += w.sum(0)
                second += w.T @ w
        yield pd.DataFrame(np.column_stack([np.arange(k), first, second]), columns=["i", "s", *[f"v{j}" for j in range(k)]])

    parts = whitened.select("whitened").mapInPandas(products, ", ".join(f"{c} double" for c in ["i", "s", *[f"v{j}" for j in range(k)]]))
    added = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in ["s", *[f"v{j}" for j in range(k)]]]).toPandas().sort_values("i").drop(columns="i").to_numpy()
    mean = added[:, 0] / n
    error = np.abs(added[:, 1:] / n - np.outer(mean, mean) - np.eye(k))
    fine = ~np.isnan(np.diag(error))
    return float(error[np.ix_(fine, fine)].max()) if fine.any() else None


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector that takes part and each of the first components: its whitened value, and what the whole is like."""
    rows = whole_numbers(vectors, id_col, vector_col)
    model = fit(rows)
    k = min(components, len(model.sums))
    kind = rows.schema["id"].dataType.simpleString()
    if not k:
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {kind}, {RESULT}")
    done = stage(transform(rows, model, components))
    error = identity_error(done, model.n, k)
    shares = [float(e / model.trace) if e > NONE * model.trace else 0.0 for e in model.values[:k]]
    long = done.select("id", "deviation_digits", F.posexplode("whitened").alias("at", "w"))
    return long.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation_digits").try_cast("long").alias("deviation"),
        F.when(~F.isnan("w"), F.col("w")).alias("whitened"), F.element_at(F.array(*map(F.lit, shares)), F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_digits",
    )
