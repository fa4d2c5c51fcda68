"""The pipeline's stages against brute force, on nulls, repeats, long texts and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _hl_id string, _hl_copies string, _hl_copy string, _hl_kept string, _hl_lines string"


def prose(rng, n):
    return " ".join(rng.choice("the a of to and in on by it we".split()) + " " + "".join(rng.choices("abcdefgh", k=rng.randrange(3, 9))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(10, 60)) for _ in range(40)]
    texts += [None, "", " ", texts[3], texts[3] + " more", prose(rng, 30_000), texts[5] + "\n" + texts[6], "x\n\nx"]
    out = [(k, t, "en", rng.choice(["a", "b", None]), len(t) if t else None, "i", "c", "d", "k", "l") for k, t in enumerate(texts)]
    return [*out, out[7], (None, texts[9] + " end", None, None, None, None, None, None, None, None), (8, "another text under a used id " + texts[8], "en", "a", 3, "i", "c", "d", "k", "l")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_keep_columns_and_empty_tables(spark, docs, labels):
    for name, stage in P.STAGES:
        none = stage(spark, docs.limit(0), labels)
        assert none.count() == 0
        if name != "packing":
            assert stage(spark, docs, labels).columns == docs.columns


def test_quality_keeps_rows_as_they_are(spark, docs, rows, labels):
    got = plain(P.quality(spark, docs, labels))
    assert set(got) <= set(rows)
    best = {}
    for r in P.score_quality(docs, spark.read.parquet(f"{labels}/labels.parquet")).collect():
        best[r.doc_id] = max(best.get(r.doc_id, 0), r.score)
    assert got == sorted((r for r in rows if best[r[0]] >= P.LEAST_QUALITY), key=repr)


def test_lines(spark, docs, rows, labels):
    first, want = {}, []
    form = lambda x: x.strip(" \t\r\x0b\x0c").lower()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    for k in order:
        for no, line in enumerate((rows[k][1] or "").split("\n")):
            first.setdefault(form(line), (rows[k][0], no))
    for r in rows:
        if r[1] is None:
            want.append(r)
            continue
        kept = [x for no, x in enumerate(r[1].split("\n")) if not form(x) or first[form(x)] == (r[0], no)]
        text = "\n".join(kept)
        if text.strip() or len(kept) == len(r[1].split("\n")):
            want.append((*r[:1], text, *r[2:4], len(text), *r[5:]))
    assert plain(P.lines(spark, docs, labels)) == sorted(want, key=repr)  # no line of these is one edit from another


def test_near_keeps_one_of_each_group(spark, docs, rows, labels):
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append((r[0], frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    got = plain(P.near(spark, docs, labels))
    ids = {r[0] for r in got}
    linked = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    for i, s in sets:
        if i not in ids:  # what went is like something else
            assert any(j != i and linked(s, t) for j, t in sets)
    assert 43 not in ids and 44 not in ids and {40, 41, 42, 45} <= ids and set(got) <= set(rows)


def test_mixing(spark, docs, rows, labels):
    got = plain(P.mixing(spark, docs, labels))
    copies = {}
    for r in P.mix(docs).collect():
        copies[r.doc_id] = max(copies.get(r.doc_id, 0), r.copies)
    assert got == sorted((r for r in rows for _ in range(copies[r[0]])), key=repr) and max(copies.values()) == 2


def test_packing_places_every_token_once(spark, docs, rows, labels):
    got = P.packing(spark, docs, labels)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    seen = sorted((r.sequence_id, r.offset, r.length) for r in got.collect())
    for a, b in zip(seen, seen[1:]):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)
    assert got.where("start = 0").count() == len(rows)
