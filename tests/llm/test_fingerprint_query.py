"""The query of fingerprints, column by column, against a brute-force version."""

import hashlib
import random
import unicodedata

import pytest

from hireloom.llm import fingerprint
from hireloom.llm.fingerprint import edited_fingerprints


def form(text):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def rows_of(n=80):
    rng = random.Random(1)
    texts = [None, "", "a", "Ab", "ab", "é x", "É  X", "y" * 5000, *(" ".join(rng.choices(["ab", "ß", "Ｃ", "d́"], k=rng.randrange(1, 9))) for _ in range(n))] + ["copy of a text"] * 30
    ids = rng.sample(range(1000), len(texts) - 1) + [10**15]  # far from all others
    return list(zip(ids, texts, strict=True))


def wanted(rows):
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        yield i, len(t), hashlib.sha256(edited.encode()).hexdigest(), form(t), form(edited), float(form(t) == form(edited)), float(form(t) == form(nxt))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_query_columns(spark, kind, monkeypatch):
    monkeypatch.setattr(fingerprint.with_next, "__defaults__", ("doc_id", "text", 7, None))  # many ranges
    rows = rows_of()
    if kind == "string":
        rows = [(f"{i:016d}", t) for i, t in rows]
        want = [(f"{i:016d}", *r) for i, *r in wanted([(int(i), t) for i, t in rows])]
    else:
        want = list(wanted(rows))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], f"doc_id {kind}, text string, digest int, b string")
    got = {r.doc_id: r for r in edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    names = {}
    for i, n, sha, f, e, near_e, near_n in want:
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (n, sha, near_e, near_n)
        for name, text in ((r.fingerprint, f), (r.edited_fingerprint, e)):
            assert names.setdefault(name, text) == text
    assert len(names) == len(set(names.values()))


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert edited_fingerprints(empty).count() == 0
    one = edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    odd = spark.createDataFrame([(None, "a"), (None, "b"), (3, "c"), (3, "c")], "doc_id long, text string")
    assert len(edited_fingerprints(odd).collect()) == 4


def test_colliding_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "digest", lambda form: fingerprint.F.lit("same"))
    docs = spark.createDataFrame([(1, "abcd"), (2, "xyzw"), (3, "ABCD")], "doc_id long, text string")
    got = {r.doc_id: r for r in edited_fingerprints(docs).collect()}
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint
    assert got[2].edited_fingerprint == "same-" + hashlib.sha256(b"xyab").hexdigest()
