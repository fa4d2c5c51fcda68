"""Toxicity: held-out accuracy, unseen misspellings, odd rows; pieces and features against a plain reading."""

import random
import zlib

import numpy as np
import pytest

from hireloom.llm.toxicity import BITS, PASSAGE, STEP, Words, _data, best_passages, op13_toxicity, score_toxicity, word_scores

SYLLABLES = ["ar", "ben", "col", "du", "en", "fi", "gor", "ha", "il", "jo", "ka", "lem", "mi", "nor", "os", "pel", "qua", "ri", "sut", "ton"]
BAD = ["grumpfish", "snortwell", "blighter", "muckspout"]
DOCS, LABELS = "doc_id long, text string, toxic int, id string, score double", "doc_id long, quality int, toxic int, text string"


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = ["".join(rng.choices(SYLLABLES, k=rng.choice((1, 2, 3)))) for _ in range(rng.randrange(5, 120))]
        toxic = k % 4 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(BAD))
        docs.append((k, " ".join(words), 0, "i", 0.5))
        labels.append((k, None, int(toxic), "t"))
    return docs, labels


def held(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus()
    misspelt = [(10_000 + k, f"arben colto {w} kalem nor", 0, "i", 0.0) for k, w in enumerate(["grumpfishes", "GRUMPFISSH", "snortwel", "bllighter", "muckspouty", "blighterr"])]
    half = " ".join(d[1] for d in docs if d[0] % 4) * 60
    long = [(20_000, f"{half} {half}", 0, "i", 0.0), (20_001, f"{half} muckspout {half}", 0, "i", 0.0)]
    odd = [(30_000, None, 0, "i", 0.0), (30_001, "", 0, "i", 0.0), (30_002, " \n\t ", 0, "i", 0.0), (None, "you blighter", 0, "i", 0.0), (30_003, "x" * 700_000, 0, "i", 0.0), docs[4], docs[4]]
    more = [(30_000, None, None, "t"), (4, None, 0, "t"), (None, None, 1, "t")]  # an id of two labels is toxic
    lied = [(k, q, 1 - t if held(k) else t, x) for k, q, t, x in labels]  # held-out labels are not read
    out = score_toxicity(spark.createDataFrame(docs + misspelt + long + odd, DOCS), spark.createDataFrame(lied + more, LABELS)).collect()
    assert len(out) == len(docs) + len(misspelt) + len(long) + len(odd)
    return docs, labels, out


def test_held_out(scored):
    docs, labels, out = scored
    by = {r["doc_id"]: r for r in out}
    assert all(r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"])) and 0 <= r["score"] <= 1 for r in out)
    right = [(by[k]["score"] >= 0.5) == (t == 1) for k, _, t, _ in labels if held(k)]
    assert len(right) > 100 and np.mean(right) >= 0.97


def test_misspellings_long_and_odd(scored):
    docs, labels, out = scored
    by = {r["doc_id"]: r["score"] for r in out}
    assert sum(by[10_000 + k] >= 0.5 for k in range(6)) >= 5
    assert by[20_000] < 0.5 <= by[20_001]  # one word in the middle of millions of characters
    assert by[30_000] == by[30_001] == by[30_002] < 0.5 and by[30_003] < 0.5 <= by[None]
    assert len({r["score"] for r in out if r["doc_id"] == 4}) == 1


def test_no_labels_and_no_rows(spark):
    docs, labels = corpus(8)
    for some in ([], [x for x in labels if x[2] == 0], [(k, 1, None, "t") for k in range(8)]):
        out = score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(some, LABELS)).collect()
        assert len(out) == 8 and {r["score"] for r in out} == {0.0}
    assert score_toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0


def test_sample_is_bounded(spark):
    from hireloom.llm.toxicity import training_sample

    docs, labels = corpus(200)
    texts, toxic = training_sample(spark.createDataFrame(docs * 3 + [(0, "w " * 9000, 0, "i", 0.0)], DOCS), spark.createDataFrame(labels, LABELS), "doc_id", "text", "toxic", 20, 16_384)
    assert len(texts) <= 40 and toxic.any() and not toxic.all() and max(map(len, texts)) <= 16_384


def plain_words(text):
    return _data(text).split()


def plain_features(word, words):
    """Buckets of a word by itself between blanks."""
    alone = Words(np.frombuffer(b" " + word + b" ", np.uint8))
    return sorted(int(b) for _, found in alone.features() for b in found)


def test_features_and_passages():
    text = "Ünï code's\x0bx  y z\n" + "ab " * 25 + "zebra! " * 3
    words = Words(np.frombuffer(_data(text), np.uint8))
    found = [[] for _ in words.start]
    for word, bucket in words.features():
        for w, b in zip(word.tolist(), bucket.tolist(), strict=True):
            found[w].append(b)
    plain = plain_words(text)
    assert [sorted(f) for f in found] == [plain_features(w, plain) for w in plain]
    assert [len(f) for f in found] == [1 + sum(max(0, len(w) + 2 - n + 1) for n in (3, 4, 5, 6)) for w in plain]
    u = np.random.default_rng(1).normal(size=1 << BITS)
    each = [np.mean(u[f]) for f in found]
    assert np.allclose(word_scores(words, u), each)
    want = max(0.25 + sum(each[at : at + PASSAGE]) / PASSAGE for at in range(0, max(1, len(each) - PASSAGE + STEP), STEP))
    assert np.allclose(best_passages([_data(text)], u, 0.25, 1 << 19), want)


def test_pieces_lose_no_passage():
    rng = random.Random(2)
    words = ["".join(rng.choices(SYLLABLES, k=2)) for _ in range(400)]
    u = np.zeros(1 << BITS)
    bad = "muckspout"
    for _, bucket in Words(np.frombuffer(_data(bad), np.uint8)).features():
        u[bucket] = 1
    for at in range(0, 400, 7):
        text = " ".join([*words[:at], bad, *words[at:]])
        one = best_passages([_data(text)], u, 0.0, 1 << 19)
        cut = best_passages([_data(text)], u, 0.0, 300)
        assert one > 0.09 and cut > 0.09


def test_query(spark):
    out = op13_toxicity(spark, "/root/testdata/sf0.001").toPandas()
    assert list(out.columns) == ["doc_id", "held_out", "score", "predicted"] and (out["predicted"] == (out["score"] >= 0.5)).all()
