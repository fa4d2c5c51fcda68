"""Near-duplicate documents by MinHash.

1. Each text becomes its set of hashed word shingles, the minima of many universal
   hash functions over it, and a key a band of minima. Texts with equal sets
   are one class from here on, so exact copies cost nothing further.
2. Classes that share a band's key are candidates. Each is tied to the least of
   its bucket, never to all; connected components of these ties are *clusters*,
   and every pair that shares a bucket is within one.
3. Clusters are dealt to blocks of bounded size. A block's task compares
   signatures, then confirms on the full sets, skipping what is joined already.
   A few members stand in every block of a cluster and tie its blocks together.
4. Pairs in different blocks that are still apart are compared block by block, after
   sorting out the blocks in which all are joined already. What is emitted is a
   spanning forest of confirmed links, not pairs.
5. Components by alternating large-star and small-star.

Bands are chosen so that a pair right at the threshold shares no key with a
probability under 1e-6. A link is always confirmed exactly; pairs whose signatures
agree in 5.3 standard deviations fewer places than the threshold's mean are not
looked at, which misses a pair right at the threshold with about 1e-6 too.

A null or empty text has no shingles and is linked with nothing. A text of fewer
words than a shingle has one, the whole. Rows with the same id and text share a result.
An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table
from .components import connected_components

N_HASHES = 120
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_RANDOM = np.random.RandomState(7)
_A = (_RANDOM.randint(0, 2**63, N_HASHES, np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RANDOM.randint(0, 2**63, N_HASHES, np.int64).astype(np.uint64)


class _WordHash(dict):
    """64-bit hashes of words met so far, a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _WordHash()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k lower-cased words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array([_WORDS[x] for x in words], np.uint64)
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = h * _MUL + w[j : len(w) - k + 1 + j]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return np.unique(h)


def signatures(sets: list[np.ndarray], at_once: int = 4096) -> np.ndarray:
    """(sets, N_HASHES) uint32: the least of (a x + b) / 2^32 over each set, for each a, b."""
    out = np.full((len(sets), N_HASHES), 2**32 - 1, np.uint32)
    some = [k for k, s in enumerate(sets) if len(s)]
    while some:
        n, take = 0, []
        while some and (not take or n + len(sets[some[0]]) <= at_once):
            n += len(sets[some[0]])
            take.append(some.pop(0))
        x = np.concatenate([sets[k] for k in take])
        starts = np.cumsum([0, *(len(sets[k]) for k in take[:-1])])
        for lo in range(0, len(x), at_once) if len(take) == 1 else (0,):
            part = x[lo : lo + at_once] if len(take) == 1 else x
            m = (_A[:, None] * part[None, :] + _B[:, None]) >> np.uint64(32)
            least = np.minimum.reduceat(m, starts, axis=1).astype(np.uint32).T
            out[take] = np.minimum(out[take], least)
    return out


def choose_bands(percent: int, n: int = N_HASHES, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the most rows with which a pair at the threshold is missed with
    a probability of miss at most."""
    t = percent / 100
    rows = max((r for r in range(1, 13) if (1 - t**r) ** (n // r) <= miss), default=1)
    return n // rows, rows


def _signed(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n, key, bands, sig): the size of the set, its 128-bit hash, band keys, minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t, k) for t in part.column(1).to_pylist()]
                sig = signatures(sets)
                keys = np.zeros((len(sets), bands), np.uint64)
                for b in range(bands):
                    h = np.full(len(sets), b + 1, np.uint64)
                    for j in range(rows):
                        h = (h ^ sig[:, b * rows + j]) * _MUL
                        h ^= h >> np.uint64(31)
                    keys[:, b] = h
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())), pa.array([x.tobytes() for x in sig], pa.binary()),
                    ],
                    names=["id", "n", "key", "bands", "sig"],
                )

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema[0].dataType.simpleString()}, n long, key binary, bands array<long>, sig binary")


def _with_sets(docs: DataFrame, id_col: str, text_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """wanted (with id) plus set, the full set of shingles of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = pa.array([shingles(t, k).tobytes() for t in part.column(0).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], sets], names=[*part.schema.names[1:], "set"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_hl_text")).join(wanted, "id")
    rows = rows.select("_hl_text", *wanted.columns)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema)
    return rows.mapInArrow(run, f"{kinds}, set binary")


def _links(ids: np.ndarray, label: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """A spanning forest of confirmed links among rows; rows with one label are joined already."""
    n = len(ids)
    _, first = np.unique(label, return_inverse=True)
    root = first.copy()  # the class of each row; few enough rows to rename a class at once
    t = percent / 100
    least = N_HASHES * t - 5.3 * np.sqrt(N_HASHES * t * (1 - t))
    sizes = np.array([len(s) for s in sets])
    found = []
    for i in range(1, n):
        near = np.flatnonzero(root[:i] != root[i])
        lo, hi = np.minimum(sizes[near], sizes[i]), np.maximum(sizes[near], sizes[i])
        near = near[100 * lo >= percent * hi]
        if not len(near):
            continue
        agree = (sig[near] == sig[i]).sum(1)
        order = np.argsort(-agree, kind="stable")
        for j, a in zip(near[order], agree[order], strict=True):
            if a < least:
                break
            if root[j] == root[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both and 100 * both >= percent * (sizes[i] + sizes[j] - both):
                found.append((ids[j], ids[i]))
                root[root == root[i]] = root[j]
    return found


def _confirm(dealt: DataFrame, keys: list[str], percent: int, id_type: str) -> DataFrame:
    """(a, b): links within groups of bounded size; dealt has keys, id, label, sig, set."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id")
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, N_HASHES)
        sets = [np.frombuffer(s, np.uint64) for s in pdf["set"]]
        ids = pdf["id"].to_numpy()
        return pd.DataFrame(_links(ids, pdf["label"].to_numpy(), sig, sets, percent), columns=["a", "b"])

    return dealt.groupBy(*keys).applyInPandas(run, f"a {id_type}, b {id_type}")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 200) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): one row a row of docs."""
    bands, rows = choose_bands(percent)
    id_type = docs.schema[id_col].dataType.simpleString()
    signed = saved(_signed(docs, id_col, text_col, words, bands, rows), "signed")
    classes = saved(signed.where("n > 0").groupBy("key").agg(F.min("id").alias("rep")), "classes")
    reps = signed.join(classes.select("key", F.col("rep").alias("id")), ["key", "id"]).dropDuplicates(["key"])

    # candidates: the least of each bucket and its other members
    buckets = reps.select("id", F.posexplode("bands").alias("band", "value"))
    heads = buckets.groupBy("band", "value").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    heads = saved(heads, "heads")  # a bucket's members meet its least in a join of files, which Spark can split
    ties = buckets.join(heads, ["band", "value"]).where("head <> id").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    clusters = saved(connected_components(ties), "clusters")
    sizes = saved(clusters.groupBy("component").agg(F.count("*").alias("m")), "sizes")
    members = clusters.join(sizes, "component").select(F.col("node").alias("id"), F.col("component").alias("cluster"), F.ceil(F.col("m") / block).cast("int").alias("blocks"), "m")
    members = members.join(signed.select("id", "sig").dropDuplicates(["id"]), "id")
    full = saved(_with_sets(docs, id_col, text_col, words, members).dropDuplicates(["id"]), "sets")

    # within blocks, and with a few members of the cluster that stand in all its blocks
    spread = F.xxhash64("id", F.lit("block"))
    own = F.pmod(spread, F.col("blocks")).cast("int")
    pivot = F.pmod(F.xxhash64("id", F.lit("pivot")), F.col("m")) < 8
    everywhere = F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    dealt = full.select("cluster", F.explode(everywhere).alias("block"), "id", F.col("id").alias("label"), "sig", "set")
    links = saved(_confirm(dealt, ["cluster", "block"], percent, id_type), "links")
    parts = saved(connected_components(links), "parts")

    # across blocks: only clusters of more blocks than one, only pairs that are still apart
    large = full.where("blocks > 1").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    large = saved(large, "large")
    if not large.isEmpty():
        # a part that fills blocks has blocks of its own, others share them
        per = large.groupBy("cluster", "label").agg(F.count("*").alias("n"))
        per = per.withColumn("shelves", F.ceil(F.col("n") / block).cast("int")).withColumn("big", F.col("n") >= block // 2)
        per = saved(per, "parts")
        rest = per.where("NOT big").groupBy("cluster").agg(F.sum("n").alias("rest"))
        shelf = large.join(per.select("cluster", "label", "shelves", "big"), ["cluster", "label"]).join(rest, "cluster", "left")
        name = F.when(F.col("big"), F.struct(F.col("label").alias("of"), F.pmod(spread, F.col("shelves")).alias("no"))).otherwise(F.struct(F.lit(None).cast(id_type).alias("of"), F.pmod(spread, F.ceil(F.col("rest") / block)).alias("no")))
        shelved = saved(shelf.select("cluster", name.alias("shelf"), "id", "label", "sig", "set"), "shelved")
        shelves = shelved.select("cluster", "shelf").distinct()
        x, y = shelves.alias("x"), shelves.alias("y")
        pairs = x.join(y, "cluster").where("x.shelf <= y.shelf AND (x.shelf.of IS NULL OR y.shelf.of IS NULL OR x.shelf.of <> y.shelf.of)")
        pairs = pairs.select("cluster", F.col("x.shelf").alias("s"), F.col("y.shelf").alias("t")).withColumn("pair", F.struct("s", "t"))
        to = saved(pairs.select("cluster", "pair", F.explode(F.array_distinct(F.array("s", "t"))).alias("shelf")), "pairs")
        more = saved(_confirm(shelved.join(to, ["cluster", "shelf"]), ["cluster", "pair"], percent, id_type), "links")
        parts = saved(connected_components(links.unionAll(more)), "parts")

    named = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    named = saved(named, "named")
    out = signed.select("id", "n", "key").join(named, "key", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
