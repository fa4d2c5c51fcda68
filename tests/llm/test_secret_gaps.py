import random

from hireloom.llm import secret_scan


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(secret_scan.ORDER[s.rank], s.start, s.end) for s in r.spans] for r in secret_scan.scan(docs).collect()}


def test_long_parts_meet_their_neighbours(spark):
    rng = random.Random(5)
    jwt = "eyJ0" + "".join(rng.choice("xyzXYZ01234") for _ in range(800))
    late = "q" * 80 + "B7" + "r" * 20
    got = scan(spark, [f"access_token={jwt}&client_id=app12", f"https://x.test/{'p' * 300} client_id=app12 {jwt[:40]}", f"client_id=app12 {late}", f"client_id=app12 {'.' * 201} {jwt}", f"{jwt}{' ' * 200}client_id=app12"])
    assert "weak_id" in [k for k, _, _ in got[0]]
    assert sorted(k for k, _, _ in got[1]) == ["endpoint", "weak_id", "weak_secret"]
    assert got[2][1] == ("weak_secret", 16, 16 + len(late))
    assert got[3] == []
    assert [k for k, _, _ in got[4]] == ["weak_secret", "weak_id"]
