"""Quality classifier by positive-unlabelled learning.

Trusted positives (labelled good, outside the held-out fold) and all documents as
unlabelled text give the non-negative unbiased risk

    pi R+_p(g) + max(0, R-_u(g) - pi R-_p(g)),  squared loss, g linear,

of which everything is a function of first and second moments of the features.
The moments are sums over all rows, one matrix a task and added up by entry in
Spark; the driver sees matrices of the number of features, whatever the corpus.
Where the bound at zero is slack the minimum is closed; where it binds, the
gradient steps of non-negative PU learning follow. The class prior is estimated
too: the least ratio of unlabelled to positive mass above a score.

The score is the probability of the good class, pi times the fitted density ratio,
between 0 and 1. Only the text is an input. A null or empty text has the features
of no characters and is scored like any other. Repeated rows get equal scores;
labels of ids that occur repeatedly count once a row of documents. Without any
positive label every score is 0.5. Columns other than the named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, saved, table

_SETS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"'\"()-:;", b"*#$%&+=@^_~", b"|<>[]{}/\\`"]
_CLASS = np.full(256, len(_SETS), np.uint8)  # others: bytes of longer characters, control characters
for _k, _s in enumerate(_SETS):
    _CLASS[np.frombuffer(_s, np.uint8)] = _k
N_CLASS = len(_SETS) + 1
N_FEATURES = 1 + N_CLASS * N_CLASS + 12


def features(text: str | None) -> np.ndarray:
    """Shares of pairs of character classes, and of repeated words and lines; the first is 1."""
    out = np.zeros(N_FEATURES)
    data = (text or "").encode("utf-8", "replace")
    raw = np.frombuffer(data, np.uint8)
    kind = _CLASS[raw]
    n = len(raw) + 20.0
    pairs = np.bincount(kind[:-1].astype(np.int64) * N_CLASS + kind[1:], minlength=N_CLASS * N_CLASS) if len(raw) > 1 else np.zeros(N_CLASS * N_CLASS)
    single = np.bincount(kind, minlength=N_CLASS) if len(raw) else np.zeros(N_CLASS)
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    w = len(words) + 5.0
    same = sum(map(bytes.__eq__, words, words[1:])) / w
    unlike = 1 - len(set(words)) / max(1, len(words))
    again = 1 - len(set(lines)) / max(1, len(lines))
    symbols, upper, marks, rules = single[9] / n, single[0] / (single[0] + single[1] + 20.0), single[7] / n, single[10] / n
    out[0] = 1
    out[1 : 1 + N_CLASS * N_CLASS] = np.sqrt(pairs / n)
    out[1 + N_CLASS * N_CLASS :] = (
        min(1, same / 0.05), np.sqrt(same), unlike, again, min(1, symbols / 0.02), min(1, upper / 0.3), min(1, marks / 0.02), min(1, rules / 0.02),
        np.log1p(len(words)) / 10, unlike * unlike, np.log1p(len(data) / w) / 5, min(1, len(words) / 20),
    )
    return out


def featurize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, x): the features as little-endian float32 in a binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = [features(t).astype("<f4").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.binary())], names=[id_col, "x"])

    slim = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, N_FEATURES).astype(float)


def _moments(rows: DataFrame) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Sums over rows of (x, trusted): count, mean of x, mean of x x' for all and for trusted."""
    d = N_FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, d * d))
        for batch in batches:
            x, good = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            sums[0] += (x.T @ x).ravel()
            x = x[good]
            sums[1] += (x.T @ x).ravel()
        at = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["at", "u", "p"])

    parts = rows.select("x", "trusted").mapInArrow(run, "at long, u double, p double")
    total = parts.groupBy("at").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).toPandas()  # d * d rows at most
    out = {}
    for name in ("u", "p"):
        m = np.zeros(d * d)
        m[total["at"].to_numpy(int)] = total[name].to_numpy()
        m = m.reshape(d, d)
        out[name] = (m[0, 0], m[0] / max(1, m[0, 0]), m / max(1, m[0, 0]))
    return out


def fit_risk(moments: dict[str, tuple[float, np.ndarray, np.ndarray]], prior: float, ridge: float = 1e-6, rounds: int = 200) -> np.ndarray:
    """Weights that minimise the non-negative PU risk with squared loss (1 - z)^2 / 4."""
    (_, mu, cu), (_, mp, cp) = moments["u"], moments["p"]
    damp = cu + ridge * np.trace(cu) / len(cu) * np.eye(len(cu))
    w = np.linalg.solve(damp, 2 * prior * mp - mu)
    negative = lambda w: (1 + 2 * w @ mu + w @ cu @ w) / 4 - prior * (1 + 2 * w @ mp + w @ cp @ w) / 4
    step = 1 / np.linalg.eigvalsh(damp)[-1]
    for _ in range(rounds):
        if negative(w) >= 0:
            break
        w = w + step * ((mu + cu @ w) - prior * (mp + cp @ w)) / 2  # back up until the bound is met
    return w


def _scores(rows: DataFrame, w: np.ndarray, name: str, *keep: str) -> DataFrame:
    """rows with the linear value of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = pa.array(_matrix(batch.column(len(keep))) @ w)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], value], names=[*keep, name])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "x").mapInArrow(run, f"{kinds}, {name} double")


def estimate_prior(h: DataFrame, bins: int = 400, least_share: float = 0.25) -> float:
    """Least ratio of unlabelled to positive mass above a value of h, where the
    positives above are least_share of all at least; h has h and trusted."""
    at = F.least(F.greatest(F.floor(F.col("h") * bins / 2), F.lit(0)), F.lit(bins)).cast("int")
    found = h.groupBy(at.alias("bin")).agg(F.count("*").alias("u"), F.sum(F.col("trusted").cast("int")).alias("p")).toPandas()  # bins + 1 rows
    u, p = np.zeros(bins + 1), np.zeros(bins + 1)
    u[found["bin"]], p[found["bin"]] = found["u"], found["p"]
    u, p = u[::-1].cumsum() / max(1, u.sum()), p[::-1].cumsum() / max(1, p.sum())
    keep = p >= least_share
    return float(min(1.0, (u[keep] / p[keep]).min())) if keep.any() else 0.5


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id_col, held_out, score). Labels of the held-out fold (remainder 0) are not read."""
    good = labels.where((fold(id_col) != 0) & (F.col(label_col) == 1)).select(F.col(id_col).alias("_hl_good")).distinct()
    x = saved(featurize(docs, id_col, text_col), "features")
    rows = x.join(good, x[id_col] == F.col("_hl_good"), "left").withColumn("trusted", F.col("_hl_good").isNotNull())
    rows = saved(rows.select(id_col, "x", "trusted"), "marked")
    moments = _moments(rows)
    if not moments["p"][0]:
        return rows.select(id_col, F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.lit(0.5).alias("score"))
    # With squared loss g = 2 pi h - 1, h being a density ratio that doesn't depend on pi.
    h = (fit_risk(moments, 0.5) + np.eye(N_FEATURES)[0]) / 1.0
    prior = estimate_prior(_scores(rows, h, "h", "trusted"))
    w = fit_risk(moments, prior)
    scored = _scores(rows, w, "g", id_col)
    score = F.least(F.greatest((F.col("g") + 1) / 2, F.lit(0.0)), F.lit(1.0))
    return scored.select(id_col, F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), score.alias("score"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
