"""The quality classifier against a plain computation over all rows: moments, prior, risk, scores."""

import random
import zlib

import numpy as np

from hireloom.llm import quality as Q


def corpus():
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(240):
        good = k % 3 > 0
        words = [rng.choice("alpha beta gamma delta eps zeta the of and".split()) for _ in range(rng.randrange(1, 60))]
        text = " ".join(words) + "." if good else "".join(w + rng.choice(["###", "$$", " | ", "!!!"]) for w in words)
        docs.append((k, None if k == 7 else "" if k == 9 else text, "x"))
        if k % 2:
            labels.append((k, int(good)))
    docs += [docs[11]] * 3  # repeated rows count as rows
    return docs, labels + [labels[5], (99_999, 1)]


def held(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def plain(docs, labels):
    """(score by row, prior, weights) with one loop a step."""
    good = {k for k, q in labels if q == 1 and not held(k)}
    x = np.array([Q.features(t).astype("<f4").astype(float) for _, t, _ in docs])
    trusted = np.array([k in good for k, _, _ in docs])
    moments = {n: (float(len(r)), r.mean(0), (r[:, :, None] * r[:, None, :]).mean(0)) for n, r in (("u", x), ("p", x[trusted]))}
    h = x @ (Q.fit_risk(moments, 0.5) + np.eye(Q.N_FEATURES)[0])
    bin_ = np.clip(np.floor(h * 200), 0, 400)
    ratios = [(bin_ >= b).mean() / (bin_[trusted] >= b).mean() for b in range(401) if (bin_[trusted] >= b).mean() >= 0.25]
    prior = min(1.0, min(ratios))
    w = Q.fit_risk(moments, prior)
    return np.clip((x @ w + 1) / 2, 0, 1), prior, w, x, trusted


def test_scores_are_those_of_all_rows(spark):
    docs, labels = corpus()
    want, *_ = plain(docs, labels)
    got = Q.score_quality(spark.createDataFrame(docs, "doc_id long, text string, x string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert sorted((r.doc_id, round(r.score, 6)) for r in got) == sorted((k, round(float(s), 6)) for (k, _, _), s in zip(docs, want, strict=True))
    assert all(r.held_out == held(r.doc_id) for r in got)


def test_the_weights_minimise_the_non_negative_risk():
    docs, labels = corpus()
    _, prior, w, x, trusted = plain(docs, labels)

    def risk(w):
        g = x @ w
        negative = ((1 + g) ** 2).mean() / 4 - prior * ((1 + g[trusted]) ** 2).mean() / 4
        return prior * ((1 - g[trusted]) ** 2).mean() / 4 + max(0.0, negative)

    rng = np.random.default_rng(1)
    least = risk(w)
    for size in (1e-3, 1e-2, 1e-1, 1.0):
        for _ in range(50):
            assert risk(w + size * rng.normal(size=len(w))) >= least - 1e-5
    assert 0.3 < prior <= 1.0  # two thirds are good


def test_other_labels_change_nothing(spark):
    docs, labels = corpus()
    lied = [(k, 1 - q if held(k) else q) for k, q in labels]
    frame = spark.createDataFrame(docs, "doc_id long, text string, x string")
    one, two = (sorted((r.doc_id, round(r.score, 9)) for r in Q.score_quality(frame, spark.createDataFrame(x, "doc_id long, quality int")).collect()) for x in (labels, lied))
    assert one == two
