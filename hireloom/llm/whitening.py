"""Embedding whitening by one-sided Jacobi on the R of a blockwise QR.

Components are scaled to integers, so that sums are exact. A first pass adds up every
dimension; a second centres the rows and compresses them, block by block, to one
triangle R a task, and triangles are stacked and compressed again by sixteens until few
are left (TSQR). Nothing larger than dimensions squared leaves a task, whatever the
number of rows. Plane rotations then make R's columns orthogonal; the rotations taken
together are the components and the columns' lengths the standard deviations, without
ever squaring the data into a covariance matrix. A last pass measures the covariance of
the whitened rows themselves.

Cases: a vector that is null, or holds a null or non-finite entry, or one of 2^62 and
more once scaled, takes no part; nor does one whose length is not the commonest (of
equally common ones the longest), or which is empty. Repeated rows and rows of null id
count as often as they occur. A component without variance cannot be scaled: whitened
is 0 in it, explained is 0, and identity_error leaves it out. A deviation that no long
can hold is null. No row that takes part gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table

#: Triangles that one task stacks, and that the driver gets at most.
FAN_IN = 16
_LOW = (1 << 32) - 1


def scaled(vector: Column, scale: int, shift: int = 0, limit: float = 2.0**62) -> Column:
    """floor(scale * entry) + shift as longs; null where an entry is null, not finite or too large."""
    x = vector.cast("array<double>")
    fits = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) * scale < limit))  # NaN is above all numbers
    return F.when(F.coalesce(fits, F.lit(False)), F.transform(x, lambda v: F.floor(v * scale) + F.lit(shift).cast("long")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def exact_sums(rows: DataFrame) -> tuple[int, int, list[int]]:
    """(length, rows, sum of every dimension) of the commonest length of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column(0)
            lengths = np.diff(x.offsets.to_numpy())
            for dim in np.unique(lengths).tolist():
                m = matrix(x.filter(pa.array(lengths == dim)), dim)
                total = np.vstack([m >> 32, m & _LOW, np.ones_like(m)]).reshape(3, -1, dim).sum(1)  # halves, so that no sum overflows
                held[dim] = held.get(dim, 0) + total
        for dim, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim)), pa.array(np.arange(dim)), *map(pa.array, total)], names=["dim", "at", "hi", "lo", "n"])

    parts = rows.select("x").mapInArrow(run, "dim long, at long, hi long, lo long, n long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = parts.groupBy("dim", "at").agg(wide("hi"), wide("lo"), F.sum("n").alias("n"))
    found = saved(found, "sums")
    best = found.where("at = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if best is None:
        return 0, 0, []
    sums = {r["at"]: (int(r["hi"]) << 32) + int(r["lo"]) for r in found.where(F.col("dim") == best["dim"]).collect()}  # a row a dimension
    return best["dim"], best["n"], [sums[k] for k in range(best["dim"])]


class Centre:
    """n * x - S exactly, whatever the size of x and n."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.mean, self.rest = n, [s // n for s in sums], [s % n for s in sums]

    def exact(self, x: np.ndarray) -> np.ndarray:
        """Of int64 where it fits, else of Python's integers."""
        if not len(x):
            return x
        peak = max(abs(int(x.max())), abs(int(x.min())), *map(abs, self.mean))
        kind = np.int64 if 2 * (peak + 1) * self.n < 1 << 62 else object
        return self.n * (x.astype(kind) - np.array(self.mean, kind)) - np.array(self.rest, kind)

    def deviations(self, d: np.ndarray) -> list[int | None]:
        peak = max(abs(int(d.max())), abs(int(d.min()))) if d.size else 0
        if peak * peak * d.shape[1] < 1 << 63 and d.dtype != object:
            return (d * d).sum(1).tolist()
        sums = [sum(int(v) ** 2 for v in row) for row in d]
        return [s if s < 1 << 63 else None for s in sums]

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x).astype(float) / self.n


def triangle(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(blocks), mode="r")


def tsqr(rows: DataFrame, dim: int, centre: Centre, block: int = 4096) -> np.ndarray:
    """The triangle R of the centred rows' QR factorisation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                r = triangle([r, centre.rows(matrix(batch.column(0).slice(at, block), dim))])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def stack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = triangle([np.frombuffer(x).reshape(-1, dim) for x in pdf.sort_values("part")["r"]])
        return pd.DataFrame({"part": [key[0]], "r": [r.tobytes()]})

    parts = saved(rows.select("x").mapInArrow(run, "part long, r binary"), "triangles")
    while (count := parts.count()) > FAN_IN:
        to = F.pmod("part", F.lit(-(-count // FAN_IN))).alias("to")
        parts = saved(parts.groupBy(to).applyInPandas(stack, "part long, r binary"), "triangles")
    return triangle([np.frombuffer(x["r"]).reshape(-1, dim) for x in parts.orderBy("part").collect()])


def one_sided_jacobi(r: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, columns): r's singular values, falling, and its right singular vectors.

    A sweep turns every pair of columns once, disjoint pairs together (round robin),
    until no two columns have a product above rounding.
    """
    d = r.shape[1]
    size = np.abs(r).max() if r.size else 0
    a, v = (r / size if size else r.astype(float)), np.eye(d)
    order, tolerance = list(range(d + d % 2)), d * np.finfo(float).eps
    for _ in range(most_sweeps):
        turned = False
        for _ in range(len(order) - 1):
            pairs = [(p, q) for p, q in zip(order[: len(order) // 2], order[::-1], strict=False) if p < d and q < d]
            order = [order[0], order[-1], *order[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            on = np.abs(xy) > tolerance * np.sqrt(xx * yy)
            if not on.any():
                continue
            turned = True
            zeta = np.where(on, (yy - xx) / np.where(on, 2 * xy, 1), 0)
            t = np.where(on, np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            c = 1 / np.hypot(1, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            x, y = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    lengths = np.sqrt((a * a).sum(0)) * size
    fall = np.argsort(-lengths, kind="stable")
    v = v[:, fall] / np.sqrt((v * v).sum(0))[fall]
    return lengths[fall], v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1, 1)


def identity_error(rows: DataFrame, dim: int, centre: Centre, map_: np.ndarray) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, from the rows."""
    k = map_.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = centre.rows(matrix(batch.column(0), dim)) @ map_
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    found = rows.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # k * k rows
    total = np.zeros((k + 1) * k)
    total[found["at"]] = found["v"]
    total = total.reshape(k + 1, k) / centre.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max()) if k else 0.0


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): see the module."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), scaled(F.col(vector_col), scale, shift).alias("x")).where(F.size("x") > 0)
    dim, n, sums = exact_sums(rows)
    if not n:
        return rows.where(F.lit(False)).select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))))
    rows, centre = rows.where(F.size("x") == dim), Centre(n, sums)
    lengths, axes = one_sided_jacobi(tsqr(rows, dim, centre))
    spread = lengths / np.sqrt(n)
    real = spread > 4 * dim * np.finfo(float).eps * spread[0]
    variances = np.where(real, spread * spread, 0)
    explained = variances / (variances.sum() or 1)
    k = min(components, dim)
    map_ = axes[:, :k] * np.where(real[:k], 1 / np.where(real[:k], spread[:k], 1), 0)
    error = identity_error(rows, dim, centre, map_[:, real[:k]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = centre.exact(matrix(batch.column(1), dim))
            w = (d.astype(float) / n) @ map_
            white = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centre.deviations(d), pa.int64()), white], names=["id", "deviation", "w"])

    out = rows.mapInArrow(run, f"id {id_type}, deviation long, w array<double>")
    out = out.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.get(F.array(*(F.lit(float(e)) for e in explained[:k])), F.col("at"))
    return out.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
