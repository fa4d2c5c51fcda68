"""Hard-negative mining by product quantisation with stored residual norms.

Vectors are scaled to integers; a score is their integer inner product. Rows with equal
vector and label score alike, so they are one class, of which the few smallest ids are
all that can be returned. Codebooks of two dimensions each are fitted on a bounded
sample of classes (`sample` rows in the order of their hashes); every class is encoded
with them, and what the code leaves over is stored as its length. An anchor's products
with the codebooks are look-up tables: their sum plus or minus |anchor| * |residual|
holds the true score, so

* a row of the anchor's label whose upper bound is below the sixth best lower bound is
  not among its positives;
* a row of another label whose bounds miss a positive's window, or whose upper bound is
  below the third best lower bound of rows surely in the window, is not among its
  negatives.

What these leave is scored in integers, so the result is that of brute force. Tasks take
a tile of classes and a block of anchors, both of bounded size, and return the few best
of each anchor and window; a label or a vector that holds a third of all rows changes
neither tiles nor what they return. The work is the number of anchors times the number
of classes, as the contract says; rows sent are classes times blocks of anchors.

Cases: a row of null id (it could not be named), null label or null vector, or with a
null or non-finite component takes no part; nor does one whose components, scaled, are so
large that a score could leave a long, one whose vector is empty, or one whose vector has
not the commonest length (of equally common ones the longest). Repeated rows (id, label
and vector equal) count once; rows of one id that differ are rows of their own. Ids and
labels are integers. No anchor, no positive or nothing in the window gives no row.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table
from .whitening import matrix, scaled

_EPS = 1.2e-7  # of single precision, in which tables are added up


def fit_codebooks(x: np.ndarray, width: int, centroids: int, rounds: int = 8) -> list[np.ndarray]:
    """Centroids of every `width` dimensions by Lloyd's rounds from evenly spaced rows."""
    out = []
    for part in (x[:, at : at + width].astype(float) for at in range(0, x.shape[1], width)):
        distinct = np.unique(part, axis=0)
        c = distinct[np.linspace(0, len(distinct) - 1, min(centroids, len(distinct))).astype(int)]
        for _ in range(rounds):
            near = nearest(part, c)
            count = np.bincount(near, minlength=len(c))
            sums = np.stack([np.bincount(near, part[:, k], len(c)) for k in range(part.shape[1])], 1)
            c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
        out.append(c)
    return out


def nearest(part: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * part @ c.T).argmin(1)


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths of what they leave over, not rounded down)."""
    codes, rest, at = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x)), 0
    for k, c in enumerate(books):
        part = x[:, at : at + c.shape[1]].astype(float)
        at += c.shape[1]
        codes[:, k] = nearest(part, c)
        rest += ((part - c[codes[:, k]]) ** 2).sum(1)
    return codes, np.sqrt(rest) * (1 + 1e-9)


def bounds(anchors: np.ndarray, codes: np.ndarray, rest: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of rows (down) with anchors (across)."""
    total, at = np.zeros((len(codes), len(anchors)), np.float32), 0
    a = anchors.astype(float)
    for k, c in enumerate(books):
        total += (c @ a[:, at : at + c.shape[1]].T).astype(np.float32)[codes[:, k]]
        at += c.shape[1]
    length = np.sqrt((a * a).sum(1))
    most = np.sqrt(sum((c * c).sum(1).max() for c in books))
    off = rest[:, None] * length + (len(books) + 4) * _EPS * (most + rest.max(initial=0)) * length + 1e-6
    total = total.astype(float)
    return total - off, total + off


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """By column; below everything where there are fewer."""
    return np.partition(values, len(values) - k, axis=0)[-k] if len(values) >= k else np.full(values.shape[1], -np.inf)


class _Tile:
    """The rows of one task; scores between them and anchors."""

    def __init__(self, pdf: pd.DataFrame, dim: int, places: int) -> None:
        ids = [v[:places] for v in pdf["ids"]]
        self.x, self.label = _ints(pdf["x"], dim), pdf["label"].to_numpy()
        self.codes = np.frombuffer(b"".join(pdf["codes"]), np.uint8).reshape(len(pdf), -1)
        self.rest, self.count = pdf["rest"].to_numpy(), np.array([len(v) for v in ids], np.int64)
        self.ids = np.zeros((len(ids), places), np.int64)
        for k, v in enumerate(ids):
            self.ids[k, : len(v)] = v

    def scores(self, a: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for at in range(0, len(i), 1 << 16):
            out[at : at + (1 << 16)] = np.einsum("ij,ij->i", self.x[i[at : at + (1 << 16)]], a[j[at : at + (1 << 16)]])
        return out

    def best(self, group: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, score, id) of the k best of each group, classes taken apart into ids."""
        many = self.count[row]
        group, score, row = np.repeat(group, many), np.repeat(score, many), np.repeat(row, many)
        ids = self.ids[row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        first = np.searchsorted(group, group)
        keep = np.arange(len(group)) - first < k
        return group[keep], score[keep], ids[keep]


def _ints(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(-1, dim).astype(np.int64)


def _deal(classes: DataFrame, anchors: DataFrame, tiles: int, blocks: int, run, schema: str) -> DataFrame:
    """run(anchors, rows) for each tile of classes and block of anchors."""
    own = lambda n: F.pmod(F.xxhash64("cid"), F.lit(n)).cast("int")
    rows = classes.withColumn("tile", own(tiles)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = anchors.withColumn("block", own(blocks)).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    return asked.groupBy("tile", "block").cogroup(rows.groupBy("tile", "block")).applyInPandas(run, schema)


def positives_of(classes: DataFrame, anchors: DataFrame, books: list[np.ndarray], dim: int, k: int, tiles: int, blocks: int, step: int = 128) -> DataFrame:
    """(cid, score, id): the k best rows of an anchor class's label, itself included."""

    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for label, some in asked.groupby("label") if len(rows) else ():
            part = rows[rows["label"] == label]
            if not len(part):
                continue
            tile, a, cid = _Tile(part, dim, k), _ints(some["x"], dim), some["cid"].to_numpy()
            for at in range(0, len(a), step):
                low, high = bounds(a[at : at + step], tile.codes, tile.rest, books)
                row, j = np.nonzero(high >= kth_largest(low, k))
                group, score, ids = tile.best(j, row, tile.scores(a[at : at + step], row, j), k)
                found.append(pd.DataFrame({"cid": cid[at + group], "score": score, "id": ids}))
        return pd.concat(found) if found else pd.DataFrame({"cid": [], "score": [], "id": []}, dtype=np.int64)

    found = _deal(classes, anchors, tiles, blocks, run, "cid long, score long, id long")
    order = Window.partitionBy("cid").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def negatives_of(classes: DataFrame, anchors: DataFrame, books: list[np.ndarray], dim: int, k: int, low_share: int, high_share: int, tiles: int, blocks: int, step: int = 128) -> DataFrame:
    """(cid, positive_score, score, id, rank): the k best rows of other labels in the windows
    of an anchor class's positive scores."""

    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(rows):
            tile, a, cid, label = _Tile(rows, dim, k), _ints(asked["x"], dim), asked["cid"].to_numpy(), asked["label"].to_numpy()
            lists = asked["scores"].tolist()
            wide = max(map(len, lists))
            scores = np.array([[*s, *[-1] * (wide - len(s))] for s in lists], np.int64)  # below zero a window is empty
            least, most = -(-(scores * low_share) // 100), scores * high_share // 100
            for at in range(0, len(a), step):
                some = slice(at, at + step)
                low, high = bounds(a[some], tile.codes, tile.rest, books)
                other = tile.label[:, None] != label[some]
                high[~other], low[~other] = -np.inf, np.inf
                for w in range(wide):
                    lo, hi = least[some, w], most[some, w]
                    real = lo <= hi
                    sure = np.where((low >= lo) & (high <= hi) & other, low, -np.inf)
                    row, j = np.nonzero((low <= hi) & (high >= np.maximum(lo, kth_largest(sure, k))) & real)
                    score = tile.scores(a[some], row, j)
                    keep = (score >= lo[j]) & (score <= hi[j])
                    group, score, ids = tile.best(j[keep], row[keep], score[keep], k)
                    found.append(pd.DataFrame({"cid": cid[at + group], "positive_score": scores[at + group, w], "score": score, "id": ids}))
        return pd.concat(found) if found else pd.DataFrame({"cid": [], "positive_score": [], "score": [], "id": []}, dtype=np.int64)

    found = _deal(classes, anchors, tiles, blocks, run, "cid long, positive_score long, score long, id long")
    order = Window.partitionBy("cid", "positive_score").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, low_share: int = 50, high_share: int = 95,
    width: int = 2, centroids: int = 256, sample: int = 4096, tile: int = 8192, block: int = 8192, least_tiles: int = 16,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor and label are columns of vectors: whether a row is an anchor, and its label.
    An anchor's positives are its best other rows of the same label; the negatives of
    each are the best rows of other labels that score between low_share and high_share
    per cent of the positive.
    """
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), scaled(F.col(vector_col), scale, limit=2.0**31).alias("x"))
    rows = rows.where((F.size("x") > 0) & F.col("label").isNotNull() & F.col("id").isNotNull())
    rows = rows.where(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v.cast("double")) < 2.0**62)  # then no score leaves a long
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        kinds = dict.fromkeys(names, "long") | {"rank": "int"}
        return rows.where(F.lit(False)).select(*(F.lit(None).cast(kinds[c]).alias(c) for c in names))
    dim = common["dim"]
    rows = rows.where(F.size("x") == dim).withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit("second"), "x")})
    key = ["h1", "h2", "label"]
    members = saved(rows.groupBy(*key, "id").agg(F.max("anchor").alias("anchor"), F.any_value("x").alias("x")), "members")
    order = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    least = members.select(*key, "id").withColumn("n", order).where(F.col("n") <= max(positives + 1, negatives)).groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = members.groupBy(*key).agg(F.max("anchor").alias("anchor"), F.any_value("x").alias("x")).join(least, key)
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    drawn = classes.orderBy(F.xxhash64(*key)).limit(sample).select("x").toPandas()
    books = fit_codebooks(np.array(drawn["x"].tolist(), float), width, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(3), dim)
            codes, rest = encode(x, books)
            packed = [v.tobytes() for v in x.astype("<i4")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest), batch.column(4)], names=["cid", "label", "ids", "x", "codes", "rest", "anchor"])

    encoded = classes.select("cid", "label", "ids", "x", "anchor").mapInArrow(run, "cid long, label long, ids array<long>, x binary, codes binary, rest double, anchor boolean")
    encoded = saved(encoded, "encoded")
    n, n_anchors = encoded.agg(F.count("*"), F.count_if("anchor")).first()
    tiles, blocks = max(least_tiles, -(-n // tile)), max(1, -(-n_anchors // block))
    rows, asked = encoded.select("cid", "label", "ids", "x", "codes", "rest"), encoded.where("anchor").select(*(F.col(c).alias(c) for c in ("cid", "label", "x")))

    best = saved(positives_of(rows, asked, books, dim, positives + 1, tiles, blocks), "best")
    anchors = members.where("anchor").select(*key, F.col("id").alias("anchor_id")).join(classes.select(*key, "cid"), key).select("anchor_id", "cid")
    pairs = anchors.join(best, "cid").where(F.col("id") != F.col("anchor_id"))
    nth = F.row_number().over(Window.partitionBy("anchor_id", "cid").orderBy(F.desc("score"), "id"))
    pairs = saved(pairs.withColumn("n", nth).where(F.col("n") <= positives).select("anchor_id", "cid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    windows = pairs.groupBy("cid").agg(F.collect_set("positive_score").alias("scores"))  # one more than the positives at most
    asked = asked.join(windows, "cid").select(*(F.col(c).alias(c) for c in ("cid", "label", "x", "scores")))
    found = negatives_of(rows, asked, books, dim, negatives, low_share, high_share, tiles, blocks)
    out = pairs.join(saved(found, "negatives"), ["cid", "positive_score"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negative_mining(spark, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


OP11_SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS id, b.label, CAST(list_inner_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS score
  FROM r a JOIN r b ON len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 3
"""
