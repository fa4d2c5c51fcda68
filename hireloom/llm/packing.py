"""Best-fit packing of token sequences by fitted length patterns.

Documents become token ids, ids become pieces of at most one sequence, and
pieces are packed by *pattern packing*: the histogram of piece lengths (at most
``max_len`` bins, whatever the corpus) goes to the driver, patterns of two or
three lengths that fill a sequence exactly are given repeat counts by
non-negative least squares, counts are rounded down, and what is left over is
packed by best fit on the histogram. Pieces then look up their place: a piece's
rank among those of its length picks a run of the plan. Ranks come from counts
per (length, salt), so that one very common length is spread over many tasks.

Nulls and empty texts are documents of the end id alone. Repeated rows are
packed one by one. An empty table gives an empty result. Other columns of the
input are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Fixed value: how a byte-level tokenizer of this kind splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are read in lots of so many bytes.
_LOT_BYTES = 2_000_000


def _byte_of() -> dict[str, int]:
    """The byte that each character stands for in a byte-level vocabulary: printable Latin-1
    characters are themselves, the other bytes follow from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and chr(b) not in " \xa0\xad"]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


@lru_cache(maxsize=4)
def _encoder(path: str) -> Callable[[str], np.ndarray]:
    """text to ids by a tokenizer file of the tokenizers library.

    Where the file is a plain byte-level BPE whose ids are in the order of its
    merges, the same ids come from the same vocabulary as ranks, which takes less
    than a quarter of the time and no memory for what was met before.
    """
    from tokenizers import Tokenizer

    @lru_cache(maxsize=1)
    def tokenizer() -> Tokenizer:
        return Tokenizer.from_file(path)

    def whole(text: str) -> np.ndarray:
        return np.array(tokenizer().encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, pre, added = said["model"], said.get("pre_tokenizer") or {}, said.get("added_tokens", [])
    byte, special = _byte_of(), {t["content"]: t["id"] for t in added}
    plain = (
        model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not said.get("normalizer")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
    )
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model.get("merges", []))
    if plain and all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(pairs)):
        import tiktoken

        ranks = {bytes(byte[c] for c in w): k for w, k in model["vocab"].items() if w not in special}
        ranked = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            try:
                return ranked.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # a run of over a million blanks
                return whole(text)

        return encode
    return whole


def _encode(texts: list[str], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text."""
    encode = _encoder(path)
    return [encode(t.encode("utf-8", "replace").decode()).astype("<u4").tobytes() for t in texts]


def _lots(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of texts of about _LOT_BYTES bytes, one text at least."""
    size = np.cumsum([n or 0 for n in pc.binary_length(texts).to_pylist()])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _LOT_BYTES, "right")))
        yield at, end
        at = end


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0) -> DataFrame:
    """(id_col, ids binary): the ids of each text as little-endian uint32, then end_id."""
    import os

    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            for at, stop in _lots(batch.column(1)):
                part = batch.slice(at, stop - at)
                ids = [x + end for x in _encode([t or "" for t in part.column(1).to_pylist()], tokenizer_path)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    slim = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, ids binary")


def cut(tokens: DataFrame, max_len: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """One row a piece: (id_col, piece, start, length, ids). Longer documents are cut
    into pieces of max_len; what is left of a document is its first piece."""
    n = (F.octet_length("ids") / 4).cast("long")
    first = F.when(n <= max_len, n).otherwise((n - 1) % max_len + 1)
    rows = tokens.select(id_col, "ids", first.alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.when(n == 0, 0).otherwise((n - F.lit(1)) / max_len).cast("long"))).alias("piece"))
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("first") + (F.col("piece") - 1) * max_len)
    length = F.when(F.col("piece") == 0, F.col("first")).otherwise(F.lit(max_len))
    rows = rows.select(id_col, F.col("piece").cast("int").alias("piece"), start.cast("long").alias("start"), length.cast("long").alias("length"), "ids")
    return rows.withColumn("ids", F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")))


# -- the plan, on the histogram alone


def _price(rest: np.ndarray, size: int, tol: float) -> list[tuple[int, ...]]:
    """For each largest part the pair that fills the sequence with most residual."""
    found = []
    for a in range(size // 3, size):
        left = size - a
        b = np.arange((left + 1) // 2, min(a, left - 1) + 1)
        if a >= left > 0 and rest[a] + rest[left] > tol:
            found.append((a, left))
        if len(b):
            gain = rest[b] + rest[left - b]
            k = int(gain.argmax())
            if rest[a] + gain[k] > tol:
                found.append((a, int(b[k]), int(left - b[k])))
    return found


def _nnls(cols: np.ndarray, goal: np.ndarray, x: np.ndarray, rounds: int) -> np.ndarray:
    """min |Ax - goal|, x >= 0, by accelerated projected gradient; a column of A counts
    the parts in cols, 0 being no part."""
    def times(v):
        out = np.zeros(len(goal))
        for k in range(cols.shape[1]):
            out += np.bincount(cols[:, k], v, len(goal))
        out[0] = 0
        return out

    back = lambda r: r[cols].sum(1)
    probe = np.ones(len(cols))
    for _ in range(12):
        probe = back(times(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    step, y, t = 1 / (1.05 * norm), x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y + step * back(goal - times(y)))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (old - 1) / t * (new - x)
        x = new
    return x


def fit_patterns(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that hold each length as often as counted, no sum above size.

    Fewest-sequence packing: exact two- and three-part patterns by non-negative
    least squares with new patterns priced in by residual, rounded down; then
    best fit, longest first, for the rest.
    """
    have = np.zeros(size + 1)
    for k, v in counts.items():
        have[k] = v
    plan: dict[tuple[int, ...], int] = defaultdict(int)
    if have[size]:
        plan[(size,)] = int(have[size])
        have[size] = 0
    if have.sum() > 0:
        tol = max(0.3, 1e-4 * have.max())
        cols, seen, x = np.zeros((0, 3), int), set(), np.zeros(0)
        rest = have.copy()
        for _ in range(24):
            new = [p for p in _price(rest, size, tol) if p not in seen]
            if not new:
                break
            seen.update(new)
            cols = np.vstack([cols, [(*p, 0, 0)[:3] for p in new]])
            x = _nnls(cols, have, np.append(x, np.zeros(len(new))), 120)
            used = np.zeros(size + 1)
            for k in range(3):
                used += np.bincount(cols[:, k], x, size + 1)
            rest = have - used
            rest[0] = 0
        left = have.astype(np.int64)
        for k in np.argsort(-x):
            parts = [int(p) for p in cols[k] if p]
            need = defaultdict(int)
            for p in parts:
                need[p] += 1
            n = min(int(np.floor(x[k] + 1e-9)), *(int(left[p]) // m for p, m in need.items())) if x[k] >= 1 else 0
            if n > 0:
                plan[tuple(sorted(parts, reverse=True))] += n
                for p in parts:
                    left[p] -= n
        for parts, n in _best_fit(left, size).items():
            plan[parts] += n
    return sorted(plan.items(), reverse=True)


def _best_fit(left: np.ndarray, size: int) -> dict[tuple[int, ...], int]:
    """Longest first into the open sequence with the least room that is enough."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in range(size, 0, -1):
        n = int(left[length])
        while n > 0:
            space = next((s for s in range(length, size) if room.get(s)), size)
            if space == size:
                parts, m = (), n if length > size // 2 else -(-n // (size // length))
            else:
                parts, m = next(iter(room[space].items()))
                m = min(m, n)
                if m == room[space][parts]:
                    del room[space][parts]
                else:
                    room[space][parts] -= m
            put = max(1, min(space // length, n // m))
            n -= put * m
            after = room[space - put * length]
            key = parts + (length,) * put
            after[key] = after.get(key, 0) + m
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for kinds in room.values():
        for parts, n in kinds.items():
            out[parts] += n
    return out


def _runs(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 40 | first rank), the sequence of that rank less it, the offset."""
    taken, rows, base = defaultdict(int), [], 0
    for parts, n in plan:
        at = 0
        for p in parts:
            rows.append((p << 40 | taken[p], base - taken[p], at))
            taken[p] += n
            at += p
        base += n
    rows.sort()
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(3))


def pack(pieces: DataFrame, max_len: int = 2048, order: tuple[str, ...] = ("doc_id", "piece"), most_groups: int = 100_000) -> DataFrame:
    """pieces (with a long column length, 1 to max_len) plus sequence_id and offset.

    ``pieces`` is read twice: hand in a saved table. The histogram and the plan
    are bounded by max_len, never by the rows. Ranks are counted within (length,
    salt): a length has the more salts the more pieces it has, and all lengths
    together have most_groups of them and one a length, whatever the rows.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    keys, bases, offsets = _runs(fit_patterns(counts, max_len))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(keys, length.to_numpy() << 40 | rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": bases[k] + rank.to_numpy(), "offset": offsets[k]})

    unit = max(4096, sum(counts.values()) // most_groups)
    salts = pieces.sparkSession.createDataFrame([(k, 1 + n // unit) for k, n in counts.items()], "length long, _hl_salts long")  # max_len rows at most
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_hl_salt", F.pmod(F.xxhash64(*order), F.col("_hl_salts")))
    by_salt = salted.groupBy("length", "_hl_salt").agg(F.count("*").alias("_hl_n"))  # most_groups + max_len rows at most
    before = Window.partitionBy("length").orderBy("_hl_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_salt.select("length", "_hl_salt", F.coalesce(F.sum("_hl_n").over(before), F.lit(0)).alias("_hl_start"))
    ranked = salted.withColumn("_hl_rank", F.row_number().over(Window.partitionBy("length", "_hl_salt").orderBy(*order)) - 1)
    placed = ranked.join(F.broadcast(starts), ["length", "_hl_salt"])
    placed = placed.withColumn("_hl_at", place("length", (F.col("_hl_rank") + F.col("_hl_start")).cast("long")))
    return placed.select(*pieces.columns, "_hl_at.sequence_id", "_hl_at.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves; each has at most max_len ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "")).alias("ids"))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    pieces = cut(tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(saved(digest, "pieces"))
