"""Embedding near-dedup by PCA-ordered tiled comparison.

All vectors are compared by cosine, exactly, in tiles. Equal vectors are one class
first, so exact copies cost nothing further. The second-moment matrix of all unit
vectors (dimensions squared, summed over tasks) gives a rotation that puts most of
a product into its leading dimensions. A task takes two tiles of bounded size:
it multiplies the leading dimensions, bounds what is left by the product of suffix
norms, drops the pairs that cannot reach the threshold, and goes on with the
others by a few dimensions at a time; the pairs that stay are confirmed on the
vectors as given, in double precision.

A task returns how many links each of its vectors has and a spanning forest of
them, never the pairs: a group of near copies costs its members. Components come
from alternating large-star and small-star. The work is quadratic in the number
of distinct vectors by its nature (a tile meets every tile); rows sent are the
number of vectors times the number of tiles.

A vector that is null, empty, zero or holds a null or non-finite component is linked
with nothing; vectors of different lengths are not linked. Rows stand for themselves,
whatever their ids: those of equal ids are linked by their vectors only, those of null
id are linked like others. component_id is the least id that is there in a component,
null if none is; a row is kept if its id is that. An empty table gives an empty result.
Labels and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table
from .components import connected_components


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled by the largest component first, so nothing over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal columns, those that hold most of the squared length first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                u = _unit(_matrix(batch.column(0).to_pandas()))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["at", "v"])

    found = vectors.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # dim * dim rows
    moments = np.zeros(dim * dim)
    moments[found["at"]] = found["v"]
    moments = moments.reshape(dim, dim)
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1]


def near_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool, step: int = 16, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) with cosine(a[i], b[j]) >= threshold; same: a is b, i < j only."""
    ua, ub = _unit(a), _unit(b)
    ya, yb = ua @ axes, ub @ axes
    suffix = lambda y: np.sqrt(np.maximum(0, np.cumsum((y * y)[:, ::-1], 1)[:, ::-1]))
    sa, sb, d = suffix(ya), suffix(yb), a.shape[1]
    slack = threshold - 1e-9
    for lo in range(0, len(a), rows):
        part = ya[lo : lo + rows, :step] @ yb[:, :step].T
        bound = part if step >= d else part + sa[lo : lo + rows, step, None] * sb[None, :, step]
        if same:
            bound = np.triu(bound + 2, lo + 1) - 2  # the others are below any threshold
        i, j = np.nonzero(bound >= slack)
        part = part[i, j]
        i += lo
        for at in range(step, d, step):
            if not len(i):
                break
            part = part + np.einsum("ij,ij->i", ya[i, at : at + step], yb[j, at : at + step])
            rest = sa[i, at + step] * sb[j, at + step] if at + step < d else 0
            keep = part + rest >= slack
            i, j, part = i[keep], j[keep], part[keep]
        sure = np.einsum("ij,ij->i", ua[i], ub[j]) >= threshold
        yield i[sure], j[sure]


def _compare(dealt: DataFrame, axes: np.ndarray, threshold: float, id_type: str) -> DataFrame:
    """(id, links, other): counts of links, rows with links; and forest edges, rows with other."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tile", "id"])
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        a, b = pdf[pdf["tile"] == i], pdf[pdf["tile"] == j]
        if not (len(a) and len(b)):
            return pd.DataFrame({"id": pdf["id"][:0], "links": [], "other": pdf["id"][:0]})
        na, nb = a["n"].to_numpy(), b["n"].to_numpy()
        ids = np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()]) if i != j else a["id"].to_numpy()
        shift = len(a) if i != j else 0
        count, root, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in near_pairs(_matrix(a["x"]), _matrix(b["x"]), axes, threshold, i == j):
            np.add.at(count, x, nb[y])
            np.add.at(count, y + shift, na[x])
            for p, q in zip(x.tolist(), (y + shift).tolist(), strict=True):
                if (s := find(p)) != (t := find(q)):
                    root[s] = t
                    edges.append((ids[p], ids[q]))
        some = np.flatnonzero(count)
        counted = pd.DataFrame({"id": ids[some], "links": count[some]})
        return pd.concat([counted, pd.DataFrame(edges, columns=["id", "other"])]).reindex(columns=["id", "links", "other"]).astype({"links": "Int64", "other": object})

    return dealt.groupBy("i", "j").applyInPandas(run, f"id {id_type}, links long, other {id_type}")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = 4096, least_tiles: int = 16) -> DataFrame:
    """(id_col, n_links, component_id, kept): one row a row of vectors."""
    x = F.col(vector_col).cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(odd, F.lit(True)) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(good, F.col(vector_col)).alias("x"))
    plain = F.transform("x", lambda v: v + F.lit(0.0))  # -0.0 is 0.0
    rows = rows.withColumn("h1", F.when(F.col("x").isNotNull(), F.xxhash64(plain))).withColumn("h2", F.xxhash64(F.lit("second"), plain))
    classes = rows.where("x IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.any_value("x").alias("x"))
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    found = None
    for dim, count in classes.groupBy(F.size("x")).count().collect():  # as a rule one
        of = classes.where(F.size("x") == dim)
        axes = principal_axes(of, dim)
        tiles = max(least_tiles, -(-count // tile))
        own = F.pmod(F.xxhash64("cid"), F.lit(tiles)).cast("int")
        pair = lambda t, k: F.struct(F.least(t, k).alias("i"), F.greatest(t, k).alias("j"))
        dealt = of.select(F.col("cid").alias("id"), "n", "x", own.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("k"))
        dealt = dealt.select("id", "n", "x", "tile", pair(F.col("tile"), F.col("k")).alias("p")).select("id", "n", "x", "tile", "p.i", "p.j")
        part = _compare(dealt, axes, threshold, "long")
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = classes.select(F.col("cid").alias("id"), F.col("n").alias("links"), F.col("cid").alias("other"))
    found = saved(found, "links")
    counts = found.where("links IS NOT NULL").groupBy(F.col("id").alias("cid")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = classes.select("h1", "h2", "id", "n", "cid").join(counts, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left")
    named = saved(named.select("h1", "h2", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "cid").alias("group")), "named")
    least = saved(named.groupBy("group").agg(F.min("id").alias("component")), "least")
    named = saved(named.select("h1", "h2", "links", "group").join(least, "group").select("h1", "h2", "links", "component"), "component")
    out = rows.select("id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
