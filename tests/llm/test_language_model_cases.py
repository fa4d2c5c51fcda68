"""Scoring where there is little to learn from: empty tables, no training rows, odd ids, very long texts."""

import random
import zlib

import numpy as np

from hireloom.llm import language_model

SCHEMA = "doc_id long, text string, id string, token double, score int, block string"


def held(k):
    return k is not None and zlib.crc32(str(k).encode()) % 5 == 1


def scored(spark, rows, **more):
    return language_model.score_texts(spark.createDataFrame([(*r, "i", 1.0, 2, "b") for r in rows], SCHEMA), **more)


def base_scores(rows):
    tokens = [(k, (t or "").encode().lower().split() + [b"\n"]) for k, t in rows]
    count: dict = {}
    for k, ws in tokens:
        for w in ws if not held(k) else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    return [(k, held(k), len(ws), sum(w in count for w in ws), n, round(float(sum(np.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws)), 4)) for k, ws in tokens]


def told(out):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out), key=str)


def test_empty_table(spark):
    out = scored(spark, [])
    assert out.count() == 0 and out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]


def test_no_training_rows(spark):
    rows = [(k, t) for k, t in zip([k for k in range(60) if held(k)], ["a b", "", None, "B c d"], strict=False)]
    out = scored(spark, rows).collect()
    assert told(out) == sorted(base_scores(rows), key=str) and all(np.isfinite(r.score) and r.score <= 0 for r in out)


def test_repeated_and_null_ids_and_long_texts(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "δέλτα", "x" * 3000]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(30)))) for k in range(40)]
    rows += [rows[3]] * 3 + [(None, "alpha beta"), (None, None), (7, "another text of id seven")]
    rows += [(500, " ".join(rng.choices(words[:4], k=200_000))), (501, "y" * 500_000)]
    out = scored(spark, rows, tokens_a_block=1000).collect()
    assert told(out) == sorted(base_scores(rows), key=str)
    assert all(np.isfinite(r.score) and r.score < 0 and r.bits_per_byte > 0 for r in out)
    same = [r.score for r in out if r.doc_id == 3]
    assert len(same) == 4 and max(same) - min(same) < 1e-9
