"""Near vectors: ids that are null, repeated or of another kind, empty tables, clashing names."""

import numpy as np

from hireloom.llm.embedding_dedup import near_vectors

SCHEMA = "vec_id long, embedding array<float>, id string, x long, n int, h1 int, links string, component long"


def near(spark, rows):
    df = spark.createDataFrame([(*r, "i", 1, 2, 3, "l", 4) for r in rows], SCHEMA)
    out = near_vectors(df, tile=8, least_tiles=3)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, out.collect()), key=str)


def test_null_ids_are_linked(spark):
    assert near(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (None, [0.01, 1.0]), (None, None), (7, [-1.0, 0.0])]) == sorted(
        [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (7, 0, 7, True)], key=str
    )


def test_brute_force_with_repeats(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 5))
    x = np.vstack([base[rng.integers(12, size=80)] + rng.normal(scale=0.25, size=(80, 5)), np.repeat(base[:1], 40, 0)]).astype(np.float32)
    ids = [int(k) if k % 9 else None for k in range(120)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    reach = link | np.eye(120, dtype=bool)
    for _ in range(7):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    least = [min((ids[j] for j in np.flatnonzero(r) if ids[j] is not None), default=None) for r in reach]
    assert near(spark, [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]) == sorted(((ids[k], int(link[k].sum()), least[k], ids[k] == least[k]) for k in range(120)), key=str)


def test_nothing(spark):
    assert near(spark, []) == []
    assert near(spark, [(3, None), (4, [0.0, 0.0]), (5, []), (6, [float("nan")])]) == [(k, 0, k, True) for k in (3, 4, 5, 6)]
    assert near(spark, [(1, [1.0]), (2, [1.0, 0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]  # of different lengths
