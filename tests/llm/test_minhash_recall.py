"""Near-duplicates on a driver's table against all pairs of full sets: every row, every link."""

import os
import re
from collections import Counter

import duckdb
import pytest

from hireloom.llm.minhash import op4_minhash_near_dedup


def linked(texts):
    """({doc_id: size of its set}, [(a, b)] of all links), by an index of shingles."""
    sets, index = {}, {}
    for k, t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[k] = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
    links = []
    for k in sorted(sets):
        shared = Counter()
        for s in sets[k]:
            shared.update(index.get(s, ()))
            index.setdefault(s, []).append(k)
        links += [(j, k) for j, n in shared.items() if 100 * n >= 85 * (len(sets[j]) + len(sets[k]) - n)]
    return {k: len(s) for k, s in sets.items()}, links


def components(sizes, links):
    root = {k: k for k in sizes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k: find(k) for k in sizes}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_no_link_is_missed(spark, sf):
    path = f"/root/testdata/{sf}"
    if not os.path.exists(path):
        pytest.skip("no test data")
    sizes, links = linked(duckdb.sql(f"SELECT doc_id, text FROM '{path}/documents.parquet'").fetchall())
    of = components(sizes, links)
    assert len(links) > 50
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op4_minhash_near_dedup(spark, path).collect()}
    assert got == {k: (sizes[k], of[k], of[k] == k) for k in sizes}
