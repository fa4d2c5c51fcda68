"""Hard negatives against brute force: ties, copies, hot labels, odd rows; bounds hold."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from hireloom.llm.hard_negatives import OP11_SQL, bounds, encode, fit_codebooks, mine_hard_negatives, op11_hard_negative_mining

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x string, score double"


def brute(rows, every=50):
    """The contract, row by row."""
    held = {}
    for vec_id, v, label in rows:
        if vec_id is None or label is None or not v or any(c is None or not np.isfinite(c) for c in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        held[vec_id, label, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)] = None
    lengths = [len(k[2]) for k in held]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    held = [k for k in held if len(k[2]) == dim]
    out = []
    for a in (k for k in held if k[0] % every == 0):
        others = sorted(((-sum(p * q for p, q in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in held if b[0] != a[0]))
        for ps, pid, _ in [o for o in others if o[2] == a[1]][:5]:
            fits = [(ns, nid) for ns, nid, label in others if label != a[1] and 50 * -ps <= 100 * -ns <= 95 * -ps][:3]
            out += [(a[0], pid, r, nid, -ps, -ns) for r, (ns, nid) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "i", "x", 1.0) for r in rows], SCHEMA)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = mine_hard_negatives(df, F.col("vec_id") % 50 == 0, moved, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def test_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(700):
        v = [rng.gauss(0, 0.4) for _ in range(7)]
        if k % 3 == 0:
            v = [0.5, -0.25, 0.125, 0.5, 0.0, 0.3, 0.1]  # a third of all rows is one vector
        rows.append((k, v, 4 if k % 2 else rng.randrange(10)))
    rows += [(None, [0.1] * 7, 1), (701, None, 1), (702, [0.1] * 6 + [None], 1), (703, [float("nan")] * 7, 2), (704, [float("inf")] * 7, 2), (705, [0.1] * 7, None), (706, [], 1), (707, [0.5] * 3, 1), (708, [1e30] * 7, 1)]
    rows += [rows[50], rows[50], (100, rows[1][1], 9)]  # repeated rows, and one id with two vectors
    rows += [(750, [0.0] * 7, 3), (800, [-0.4] * 7, 4)]
    want = brute([r for r in rows if r[0] != 708])
    assert len(want) > 100
    for more in ({}, {"tile": 40, "block": 3, "least_tiles": 2, "centroids": 4}, {"width": 3, "sample": 20}):
        assert mined(spark, rows, **more) == want


def test_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0, 2.0], 1)]) == []
    assert mined(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 1.0], 1)]) == []


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.integers(-400, 400, (500, 9))
    books = fit_codebooks(x[:100].astype(float), 2, 16)
    codes, rest = encode(x, books)
    low, high = bounds(x[:50], codes, rest, books)
    true = x @ x[:50].T
    assert (low <= true).all() and (true <= high).all() and (high - low).mean() < 2 * np.abs(true).max()


def test_query_and_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, op11_hard_negative_mining(spark, sf).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(con.sql(OP11_SQL).fetchall())
