"""Whitening against exact integer sums and an eigendecomposition."""

from collections import defaultdict
from fractions import Fraction

import numpy as np

from hireloom.llm.whitening import FAN_IN, Centre, one_sided_jacobi, op12_embedding_whitening, tsqr, whiten

SCHEMA = "vec_id long, embedding array<float>, id string, x long, component int, n int"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "i", 1, 2, 3) for r in rows], SCHEMA).repartition(parts)


def brute(rows, k):
    """{(vec_id, component): (n, deviation, whitened up to its sign, explained)}."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows]
    n, dim = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dim)]
    d = [[n * r[j] - s[j] for j in range(dim)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in d), n**3)) for j in range(dim)] for i in range(dim)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    c = np.array(d, float) / n
    return n, [sum(q * q for q in r) for r in d], (c @ u[:, :k]) / np.sqrt(e[:k]), e / e.sum()


def test_brute_force(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(5, 5))
    rows = [(int(k), (rng.normal(size=5) @ mix + 30).tolist()) for k in range(400)]
    rows += rows[:1] * 150 + [(None, rows[2][1])]  # a third of all rows is one vector; a row without id
    odd = [(9001, None), (9002, [1.0, None, 1.0, 1.0, 1.0]), (9003, [float("nan")] * 5), (9004, [float("-inf")] * 5), (9005, []), (9006, [1.0, 2.0])]
    n, deviation, white, explained = brute(rows, 3)
    for parts in (1, 4, 3 * FAN_IN):  # one triangle, some, and more than are stacked at once
        got = whiten(frame(spark, rows + odd, parts), 3).collect()
        assert len(got) == 3 * len(rows) and {r["n"] for r in got} == {n}
        by = defaultdict(dict)
        for r in got:
            by[r["vec_id"]][r["component"]] = r
        assert {i for i, _ in rows} == set(by)
        for k in range(3):
            w = np.array([by[i][k + 1]["whitened"] for i, _ in rows])
            sign = np.sign(w @ white[:, k])
            assert np.abs(w * sign - white[:, k]).max() < 1e-9
            assert abs(by[5][k + 1]["explained"] / explained[k] - 1) < 1e-12
        assert [by[i][1]["deviation"] for i, _ in rows] == deviation
        errors = {r["identity_error"] for r in got}
        assert len(errors) == 1 and errors.pop() < 1e-10


def test_without_variance(spark):
    got = whiten(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got) == [(i, c, 2, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    got = whiten(frame(spark, [(1, [0.0, 3.0]), (2, [1.0, 3.0])])).collect()  # of rank one
    assert {(r["component"], round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in got} == {(1, 1.0, 1.0), (2, 0.0, 0.0)}
    assert got[0]["identity_error"] < 1e-9


def test_empty(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        out = whiten(frame(spark, rows))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_large_entries(spark):
    """Entries whose squares leave a long: deviations are exact or null, nothing wraps around."""
    rows = [(1, [1e3, 0.0]), (2, [-1e3, 1.0]), (3, [3e9, 2.0]), (4, [1e38, 1.0])]
    got = {r["vec_id"]: r for r in whiten(frame(spark, rows), 1).collect()}
    x = {i: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v in rows[:3]}
    s = [sum(v[j] for v in x.values()) for j in range(2)]
    for i, v in x.items():
        d = sum((3 * v[j] - s[j]) ** 2 for j in range(2))
        assert got[i]["deviation"] == (d if d < 1 << 63 else None)
    assert set(got) == {1, 2, 3}


def test_jacobi_and_tsqr(spark):
    rng = np.random.default_rng(8)
    for d in (1, 2, 5, 8):
        a = rng.normal(size=(d + 3, d)) * 10.0 ** -np.arange(d)
        lengths, axes = one_sided_jacobi(np.linalg.qr(a, mode="r"))
        assert np.allclose(lengths, np.linalg.svd(a, compute_uv=False), rtol=1e-12)
        assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-13) and np.allclose((a @ axes).T @ (a @ axes), np.diag(lengths**2), atol=1e-12)
    x = rng.integers(-50, 50, (300, 3))
    centre = Centre(300, x.sum(0).tolist())
    rows = spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(20)
    r, c = tsqr(rows, 3, centre, block=7), x - x.mean(0)
    assert np.allclose(r.T @ r, c.T @ c)


def test_query(spark):
    got = op12_embedding_whitening(spark, "/root/testdata/sf0.001").toPandas()
    n = got["n"].iloc[0]
    assert len(got) == 32 * n and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    w = got.sort_values(["vec_id", "component"])["whitened"].to_numpy().reshape(n, 32)
    assert np.abs(w.T @ w / n - np.eye(32)).max() < 1e-9
