"""Language-model scoring by logistic context mixing over bits.

A text is its class, its lower-cased words and an end. Classes (such as languages)
are found without labels, in the training documents; a text's own is told first, at
the cost of its share, and is part of the contexts. A word is spelled as its bytes and a
blank, and every bit of it is predicted from several hashed contexts: the last one,
two and three bytes, and the whole of the word so far, the last three with the class. Each context's counts of
zeros and ones give a predictor; predictors are combined in the logistic domain
by weights that a gate selects (how much the longest context has seen, and whether
a byte begins), learnt online from bit to bit, and the mix is refined by an
adaptive map from what was predicted to what was seen. That is mixed with what
followed the previous word in training: with c of n occurrences of the previous word
followed by the word, and a probability p of its bits, it is (c + m p) / (n + m), which
sums to one over words. m is a power of four, times the root of n + 1, found by leaving
each training occurrence out. The sum of -log2 over the
bits of a text, by its bytes, is its total of bits per byte; nothing is cut.

In Spark: texts become blocks of documents, with the block's distinct words once and
each document as numbers of them in order. A block's words go to buckets by their
first four bytes, sorted and compressed; a bucket counts its words over the whole
corpus and numbers them, so that from then on a block's word is a number. Counts of
short contexts are tables of bounded size, summed over tasks; those of longer
beginnings of words are exact, as words with the same first bytes are in one
bucket. Weights are learnt in each partition from a common start and averaged
by what they have seen. Then each distinct word is scored once, and a bucket sends
each block the scores of its own words: a word of every document is one number a
block. Pairs of words travel the same way, as 40-bit hashes below the bucket's own
bits; a bucket sums their counts over all blocks and sends each block its own. A
text begins after an end. bits_per_byte counts the end as a byte of the text.

A null or empty text is the end alone. Words of over 64 bytes are spelled in pieces.
Rows are scored one by one, also equal ones. An empty table gives an empty result,
without training rows the model is the untrained one. Columns other than id and
text are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table

PIECE = 64
BLANK, MORE, END, REST, WHOLE = b"\x20", b"\x09", b"\x0a", b"\x0b", b"\x00"
#: Slots of the tables: last byte, last two, last three, beginnings of up to three.
SIZES = (1 << 16, 1 << 18, 1 << 19, 1 << 19)
STARTS = np.cumsum([0, *SIZES])
DELTA = 0.4
#: Counts of the longest context at which the gate changes.
LEVELS = np.array([1, 3, 8, 32, 128, 1024])
N_GATES = 2 * (len(LEVELS) + 1)
N_INPUTS = 5
BUCKETS = 33  # of the adaptive map, over -8 to 8
CHUNKS = 64
#: Bins of words by which documents are classed, axes and cells an axis.
BINS, AXES, GRID = 128, 3, 16
#: Strengths of the words' own probability against what followed the previous word.
STRENGTHS = 4.0 ** np.arange(-2, 6)


def spell(word: bytes) -> list[bytes]:
    """Keys of a word: itself and a blank, or, if it is long, a digest of the whole, for
    counting it, and its pieces."""
    if len(word) <= PIECE:
        return [word + BLANK]
    parts = [word[k : k + PIECE] for k in range(0, len(word), PIECE)]
    ends = [MORE] * (len(parts) - 1) + [BLANK]
    return [WHOLE + xxhash.xxh3_128_digest(word) + WHOLE, parts[0] + MORE, *(REST + p + e for p, e in zip(parts[1:], ends[1:], strict=True))]


def is_token(key: bytes) -> bool:
    """Whether a key, led by its class, stands for a token of its own, so that it counts as one."""
    tail, head = key[-1:], key[1:2]
    return (tail in (BLANK, END) and head != REST) or (tail == WHOLE and head == WHOLE)


def is_spelled(key: bytes) -> bool:
    return key[-1:] != WHOLE


def held_out(doc_id: object) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


class _Numbers(dict):
    """A new key gets the next number."""

    def __missing__(self, key: object) -> int:
        self[key] = number = len(self)
        return number


def _blocks(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple]:
    """Blocks of whole documents with about so many tokens: ids, sorted keys, the spelled keys'
    numbers in the order of the text, how many a document has, its bytes, and, as pairs of a
    document's place and a number, the keys that are counted but not spelled."""
    new = lambda: (_Numbers(), [], array("I"), [], [], array("I"))
    numbers, ids, order, lengths, n_bytes, whole = new()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "replace")
            units: list = raw.lower().split()
            if len(raw) > PIECE and any(len(w) > PIECE for w in units):
                spelled = []
                for word in units:
                    if len(word) <= PIECE:
                        spelled.append(word)
                        continue
                    first, *parts = spell(word)
                    whole.extend((len(ids), numbers[(first,)]))
                    spelled += [(part,) for part in parts]  # in a tuple, as it is no word
                units = spelled
            units.append((END,))
            ids.append(doc_id)
            order.extend(map(numbers.__getitem__, units))
            lengths.append(len(units))
            n_bytes.append(len(raw))
            if len(order) >= tokens:
                yield _block(numbers, ids, order, lengths, n_bytes, whole)
                numbers, ids, order, lengths, n_bytes, whole = new()
    if ids:
        yield _block(numbers, ids, order, lengths, n_bytes, whole)


def _block(numbers: _Numbers, ids: list, order: array, lengths: list[int], n_bytes: list[int], whole: array) -> tuple:
    keys = [k + BLANK if type(k) is bytes else k[0] for k in numbers]
    by = sorted(range(len(keys)), key=keys.__getitem__)
    rank = np.empty(len(keys), np.int64)
    rank[by] = np.arange(len(keys))
    pairs = np.frombuffer(whole, np.uint32).astype(np.int64).reshape(-1, 2)
    return ids, [keys[k] for k in by], rank[np.frombuffer(order, np.uint32)], np.array(lengths), np.array(n_bytes), np.stack([pairs[:, 0], rank[pairs[:, 1]]])


def packed(x: np.ndarray | bytes) -> bytes:
    """Bytes, or whole numbers as planes of their bytes, compressed."""
    raw = x if isinstance(x, bytes) else np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(x: bytes) -> bytes:
    return pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def numbers_of(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpacked(x), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time: rows are large."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _binary(rows: list[dict], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kind) for name, kind in kinds.items()], names=list(kinds))


BLOCK = ("letters", "widths", "bins", "by_count", "order", "lengths", "n_bytes", "whole")


def blocks(docs: DataFrame, tokens_a_block: int) -> DataFrame:
    """Texts as blocks, a row each: ids, sorted keys (end to end, and their lengths), the bin of
    each key, the keys by descending count, the order of the texts as places in that, how many
    spelled keys a document has, its bytes, and the keys that are counted but not spelled."""
    id_type = docs.schema["id"].dataType.simpleString()
    id_arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for no, (ids, keys, order, lengths, n_bytes, whole) in enumerate(_blocks(batches, tokens_a_block)):
            by = np.argsort(-np.bincount(order, minlength=len(keys)), kind="stable")
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            bins = bytes(zlib.crc32(k) % BINS for k in keys)
            rest = map(packed, [b"".join(keys), np.array([len(k) for k in keys]), bins, by, place[order], lengths, n_bytes, whole.ravel()])
            columns = [pa.array([part << 24 | no]), pa.array([ids], pa.list_(id_arrow)), *(pa.array([x], pa.binary()) for x in rest)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", *BLOCK])

    kinds = ", ".join(f"{name} binary" for name in BLOCK)
    return docs.select("id", "text").mapInArrow(run, f"block long, ids array<{id_type}>, {kinds}")


def _split(letters: bytes, widths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(widths).tolist()
    return [letters[i:j] for i, j in zip([0, *ends], ends, strict=False)]


class _Texts:
    """A row of blocks() as arrays."""

    def __init__(self, row: dict):
        self.block, self.ids = row["block"], row["ids"]
        self.lengths = numbers_of(row["lengths"])
        self.order = numbers_of(row["by_count"])[numbers_of(row["order"])]
        self.bins, self.letters, self.widths = np.frombuffer(unpacked(row["bins"]), np.uint8), row["letters"], row["widths"]
        self.train = np.array([not held_out(k) for k in self.ids])
        # entries: each document's distinct keys and their counts there
        doc, key = numbers_of(row["whole"]).reshape(2, -1)
        n = len(self.bins)
        used, self.times = np.unique(np.concatenate([np.repeat(np.arange(len(self.ids)), self.lengths) * n + self.order, doc * n + key]), return_counts=True)
        self.doc, self.key = used // n, used % n

    def features(self) -> np.ndarray:
        """Square roots of each bin's share of a document: rows of length 1."""
        n = len(self.ids)
        x = np.bincount(self.doc * BINS + self.bins[self.key], self.times, n * BINS).reshape(n, BINS)
        return np.sqrt(x / x.sum(1, keepdims=True))

    def keys(self) -> list[bytes]:
        return _split(unpacked(self.letters), numbers_of(self.widths))

    def classed(self, classes: Classes) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Each document's class; the distinct keys led by a class, sorted; the number among
        them of each entry; and of each place in the order of the texts."""
        keys, of = self.keys(), classes.of(classes.place(self.features()))
        used, key = np.unique(of[self.doc] * len(keys) + self.key, return_inverse=True)
        own = [bytes([k]) + keys[j] for k, j in zip((used // len(keys)).tolist(), (used % len(keys)).tolist(), strict=True)]
        order = np.searchsorted(used, np.repeat(of, self.lengths) * len(keys) + self.order)
        return of, own, key, order

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the distinct pairs of a key and the one before it, which of them
        each place in the texts has, and each one's count in training documents."""
        order, lengths = self.order, self.lengths
        own = np.array([xxhash.xxh3_64_intdigest(k) for k in self.keys()], np.uint64)
        x = own[before(order, lengths)] * np.uint64(0x9E3779B97F4A7C15) + own[order]
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
        hashes, pair = np.unique(x ^ x >> np.uint64(32), return_inverse=True)
        return hashes, pair, np.bincount(pair, np.repeat(self.train, lengths), len(hashes)).astype(np.int64)


def before(order: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What stands before each place; before a text stands an end, its last key."""
    out = np.concatenate([order[:1], order[:-1]])
    ends = np.cumsum(lengths.astype(np.int64))
    out[ends - lengths] = order[ends - 1]
    return out


# -- classes of documents


class Classes:
    """Centres of documents on their principal axes; a document's class is the nearest."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, scale: np.ndarray):
        self.mean, self.axes, self.scale = mean, axes, scale
        self.centres, self.prior = np.zeros((1, axes.shape[1])), np.ones(1)

    def place(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes / self.scale

    def of(self, y: np.ndarray) -> np.ndarray:
        return ((y[:, None] - self.centres) ** 2).sum(2).argmin(1)


def _sums(texts: DataFrame, of_block, size: int) -> np.ndarray:
    """The sum of of_block(_Texts), an array of that size, over all blocks; zeros do not travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for row in _rows(batches):
            total += of_block(_Texts(row))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "v"])

    found = texts.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # size rows at most
    out = np.zeros(size)
    out[found["at"]] = found["v"]
    return out


def find_classes(texts: DataFrame, most: int = 16, least_gain: float = 0.25) -> Classes:
    """Classes of training documents, such as languages, from two passes of bounded sums.

    Moments of the features give principal axes, and counts on a grid over them
    are parted by k-means, a class more at a time while it lowers the squared
    distance by least_gain of what is left.
    """

    def moments(t: _Texts) -> np.ndarray:
        x = np.hstack([t.features(), np.ones((len(t.ids), 1))])[t.train]
        return (x.T @ x).ravel()

    m = _sums(texts, moments, (BINS + 1) ** 2).reshape(BINS + 1, BINS + 1)
    n = max(m[-1, -1], 1)
    mean = m[-1, :-1] / n
    size, axes = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
    spread = np.sqrt(max(size[-1], 1e-12))  # one for all axes, so distances stay what they are
    classes = Classes(mean, axes[:, : -AXES - 1 : -1], np.array(spread))

    def grid(t: _Texts) -> np.ndarray:
        cell = np.clip(np.floor((classes.place(t.features()) + 4) / 8 * GRID), 0, GRID - 1).astype(int)
        return np.bincount((cell @ GRID ** np.arange(AXES))[t.train], minlength=GRID**AXES).astype(float)

    count = _sums(texts, grid, GRID**AXES)
    cells = np.flatnonzero(count)
    if not len(cells):
        return classes
    w, y = count[cells], ((cells[:, None] // GRID ** np.arange(AXES) % GRID) + 0.5) * 8 / GRID - 4
    centres, before = np.average(y, 0, w)[None], None
    while True:
        for _ in range(50):
            own = ((y[:, None] - centres) ** 2).sum(2).argmin(1)
            mass = np.bincount(own, w, len(centres))
            centres = np.stack([np.bincount(own, w * y[:, k], len(centres)) for k in range(AXES)], 1) / np.maximum(mass, 1e-9)[:, None]
        far = w * ((y[:, None] - centres) ** 2).sum(2).min(1)
        if before is not None and far.sum() > (1 - least_gain) * before:
            break
        classes.centres, classes.prior, before = centres, (mass + 1) / (mass + 1).sum(), far.sum()
        if len(centres) == min(most, len(cells)):
            break
        centres = np.vstack([centres, y[far.argmax()]])
    return classes


# -- words and pairs by bucket


def bucket_of(keys: list[bytes], buckets: int) -> np.ndarray:
    """By the first four bytes after the class, so keys with a common beginning share a bucket."""
    return np.array([zlib.crc32(k[1:5]) % buckets for k in keys], np.int64)


WORDS = {"bucket": pa.int32(), "of": pa.int64(), "letters": pa.binary(), "widths": pa.binary(), "c": pa.binary()}
VOCABULARY = {**WORDS, "numbers": pa.binary(), "in_all": pa.binary(), "n_train": pa.int64(), "v_train": pa.int64()}
SCORED = {"bucket": pa.int32(), "seen": pa.binary(), "spelled": pa.binary()}
ANSWERS = {"of": pa.int64(), "bucket": pa.int32(), "is_pair": pa.bool_(), "seen": pa.binary(), "spelled": pa.binary()}
SPARK = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}


def _schema(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {SPARK[kind]}" for name, kind in kinds.items())


def vocabulary(texts: DataFrame, classes: Classes, buckets: int) -> DataFrame:
    """A row a bucket (of is -1) with its distinct keys, sorted, their counts in training
    documents with this class and with all, and the bucket's numbers of training tokens; and a
    row a block and bucket with the numbers there of the block's keys, in their order."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            t = _Texts(row)
            _, own, key, _ = t.classed(classes)
            c = np.bincount(key, t.times * t.train[t.doc], len(own)).astype(np.int64)
            of = bucket_of(own, buckets)
            by = np.argsort(of, kind="stable")
            for some in np.split(by, np.flatnonzero(np.diff(of[by])) + 1):
                keys = [own[k] for k in some.tolist()]
                part = {"bucket": int(of[some[0]]), "of": t.block, "letters": packed(b"".join(keys)), "widths": packed(np.array([len(k) for k in keys])), "c": packed(c[some])}
                yield _binary([part], WORDS)

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [pa.array(_split(unpacked(r["letters"]), numbers_of(r["widths"])), pa.binary()) for r in rows]
        found = pa.concat_arrays(parts).dictionary_encode()
        by = pc.sort_indices(found.dictionary).to_numpy()
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        number = rank[found.indices.to_numpy()]
        keys = found.dictionary.take(pa.array(by)).to_pylist()
        c = np.bincount(number, np.concatenate([numbers_of(r["c"]) for r in rows]), len(keys)).astype(np.int64)
        words = pa.array([k[1:] for k in keys], pa.binary()).dictionary_encode().indices.to_numpy()
        in_all = np.bincount(words, c).astype(np.int64)
        token = np.zeros(len(in_all), bool)
        token[words] = [is_token(k) for k in keys]  # of all classes of a word or of none
        bucket = rows[0]["bucket"]
        out = [{"bucket": bucket, "of": -1, "letters": packed(b"".join(keys)), "widths": packed(np.array([len(k) for k in keys])), "c": packed(c), "numbers": None, "in_all": packed(in_all[words]), "n_train": int(in_all[token].sum()), "v_train": int((in_all[token] > 0).sum())}]
        for r, own in zip(rows, np.split(number, np.cumsum([len(x) for x in parts])[:-1]), strict=True):
            out.append({"bucket": bucket, "of": r["of"], "letters": None, "widths": None, "c": None, "numbers": packed(np.diff(own, prepend=0)), "in_all": None, "n_train": 0, "v_train": 0})
        return pa.Table.from_batches([_binary(out, VOCABULARY)])

    return texts.mapInArrow(deal, _schema(WORDS)).groupBy("bucket").applyInArrow(count, _schema(VOCABULARY))


def word_answers(vocab: DataFrame, scored: DataFrame) -> DataFrame:
    """For each block and bucket, how often its keys were seen and their spelled scores."""

    def look(own: pa.Table, score: pa.Table) -> pa.Table:
        rows, score = own.to_pylist(), score.to_pylist()
        out = []
        if score:
            seen, spelled = numbers_of(score[0]["seen"]), np.frombuffer(unpacked(score[0]["spelled"]), "<f4")
            for r in rows:
                at = np.cumsum(numbers_of(r["numbers"]))
                planes = np.ascontiguousarray(spelled[at].view(np.uint8).reshape(-1, 4).T).tobytes()
                out.append({"of": r["of"], "bucket": r["bucket"], "is_pair": False, "seen": packed(seen[at]), "spelled": packed(planes)})
        return pa.Table.from_batches([_binary(out, ANSWERS)])

    blocks_keys = vocab.where("of >= 0").select("bucket", "of", "numbers")
    return blocks_keys.groupBy("bucket").cogroup(scored.groupBy("bucket")).applyInArrow(look, _schema(ANSWERS))


def pair_answers(texts: DataFrame, buckets: int) -> DataFrame:
    """For each block and bucket, the counts in all training documents of its pairs, in the
    order of their hashes. A bucket holds the hashes of a range; 40 bits below it tell its
    pairs apart, whatever the number of buckets."""
    kinds = {"bucket": pa.int32(), "of": pa.int64(), "hashes": pa.binary(), "c": pa.binary()}
    edges = [(k << 64) // buckets for k in range(buckets)]
    shift = np.uint64(max(0, 64 - (buckets.bit_length() - 1) - 40))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array(edges, np.uint64)
        for row in _rows(batches):
            hashes, _, c = _Texts(row).pairs()
            at = [*np.searchsorted(hashes, starts).tolist(), len(hashes)]
            for k in np.flatnonzero(np.diff(at)).tolist():
                some = (hashes[at[k] : at[k + 1]] - starts[k]) >> shift
                yield _binary([{"bucket": k, "of": row["block"], "hashes": packed(np.diff(some, prepend=np.uint64(0))), "c": packed(c[at[k] : at[k + 1]])}], kinds)

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        hashes = [np.cumsum(numbers_of(r["hashes"])) for r in rows]
        _, pair = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(pair, np.concatenate([numbers_of(r["c"]) for r in rows])).astype(np.int64)[pair]
        own = np.split(total, np.cumsum([len(x) for x in hashes])[:-1])
        return pa.Table.from_batches([_binary([{"of": r["of"], "bucket": r["bucket"], "is_pair": True, "seen": packed(x), "spelled": None} for r, x in zip(rows, own, strict=True)], ANSWERS)])

    return texts.mapInArrow(deal, _schema(kinds)).groupBy("bucket").applyInArrow(add, _schema(ANSWERS))


def mixed(c: np.ndarray, n: np.ndarray, spelled: np.ndarray, strength: float) -> np.ndarray:
    """log10 of (c + m p) / (n + m), m being strength times the root of n + 1, from log10 of p."""
    m = strength * np.sqrt(n + 1)
    out = np.log10(m / (n + m)) + spelled
    at = np.flatnonzero(c > 0)
    out[at] = np.log10((c[at] + m[at] * 10.0 ** spelled[at]) / (n[at] + m[at]))
    return out


# -- bits of sorted keys, one bit of all keys at a time


class _Bits:
    """Sorted keys as a matrix of bytes, and what each bit's contexts are."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.order, self.count = np.array(order), counts[order].astype(float)
        words = [words[k] for k in order]
        self.size = np.array([len(w) for w in words])
        width = int(self.size.max())
        self.m = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        self.rest = self.m[:, 1] == REST[0]
        differ = self.m[1:] != self.m[:-1]
        at = differ.argmax(1)
        x = (self.m[1:] ^ self.m[:-1])[np.arange(len(at)), at]
        # bits that a key has in common with the one before it
        self.common = np.concatenate([[-1], at * 8 + 7 - np.floor(np.log2(np.maximum(x, 1))).astype(int)]) if len(words) > 1 else np.array([-1])

    def columns(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit: its depth, the keys that have it, and, for the keys that are equal up
        to it and in it, at which key they begin, the bit, slots of the short contexts, the
        number of the run of keys that are equal up to it, and the sum of their counts."""
        m, zero = self.m, np.zeros(len(self.m), np.uint32)
        live = np.arange(len(m))
        for d in range(m.shape[1]):
            live = live[self.size[live] > d]
            if d == 0:  # the class is known, as is the mark of a further piece
                continue
            live_now = live[~self.rest[live]] if d == 1 else live
            if not len(live_now):
                continue
            prev = [m[live_now, d - k].astype(np.uint32) if d >= k else zero[: len(live_now)] for k in (1, 2, 3)]
            two = prev[0] | prev[1] << np.uint32(8)
            three = two | prev[2] << np.uint32(16)
            byte = m[live_now, d].astype(np.uint32)
            own = (m[live_now, 0].astype(np.uint32) + np.uint32(1)) * np.uint32(374761393)
            h2, h3 = two * np.uint32(2654435761) ^ own, three * np.uint32(2246822519) ^ own
            h4 = (three + np.uint32((d + 1) << 24)) * np.uint32(3266489917) ^ own
            for k in range(8):
                run, bit = np.cumsum(self.common < 8 * d + k)[live_now], (byte >> np.uint32(7 - k) & np.uint32(1)).astype(np.int64)
                mark = run * 2 + bit  # keys are sorted, so equal marks are neighbours
                at = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
                node = np.uint32(1 << k) | byte[at] >> np.uint32(8 - k)
                salt = node * np.uint32(668265263)
                slots = np.stack([
                    (prev[0][at] << np.uint32(8) | node).astype(np.int64), STARTS[1] + ((h2[at] ^ salt) * np.uint32(2654435761) >> np.uint32(14)).astype(np.int64),
                    STARTS[2] + ((h3[at] ^ salt) * np.uint32(2654435761) >> np.uint32(13)).astype(np.int64), STARTS[3] + ((h4[at] ^ salt) * np.uint32(2654435761) >> np.uint32(13)).astype(np.int64),
                ])
                run = np.cumsum(np.concatenate([[0], run[at][1:] != run[at][:-1]]))
                yield 8 * d + k, live_now, at, bit[at], slots, run, np.add.reduceat(self.count[live_now], at)


def _spelled(row: dict) -> tuple[list[bytes], np.ndarray]:
    """The keys of a bucket that are spelled, and their places among all."""
    keys = _split(unpacked(row["letters"]), numbers_of(row["widths"]))
    at = np.flatnonzero(np.array([is_spelled(k) for k in keys], bool))
    return [keys[k] for k in at.tolist()], at


def _lots(keys: list[bytes], rows: int = 50_000) -> Iterator[slice]:
    """Slices of whole groups of equal first five bytes, of so many keys if groups allow."""
    at = 0
    while at < len(keys):
        end = min(len(keys), at + rows)
        while end < len(keys) and keys[end][:5] == keys[end - 1][:5]:
            end += 1
        yield slice(at, end)
        at = end


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[_Bits]:
    """Lots of the keys that training documents hold."""
    for row in _rows(batches):
        keys, at = _spelled(row)
        c = numbers_of(row["c"])[at]
        keep = np.flatnonzero(c)
        keys, c = [keys[k] for k in keep.tolist()], c[keep]
        for lot in _lots(keys):
            yield _Bits(keys[lot], c[lot])


def short_contexts(vocab: DataFrame) -> np.ndarray:
    """Counts of zeros and ones at each slot, (slots, 2): bounded, summed over all words."""
    total = int(STARTS[-1]) * 2
    part = -(-total // CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(part * CHUNKS)
        for bits in _trained(batches):
            for depth, _, _, bit, slots, _, n in bits.columns():
                for t in range(4 if depth < 40 else 3):
                    np.add.at(counts, slots[t] * 2 + bit, n)
        for k in range(CHUNKS):
            own = counts[k * part : (k + 1) * part]
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([own[at].astype("<f8").tobytes()], pa.binary())], names=["chunk", "at", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(part)
        for at, n in zip(pdf["at"], pdf["n"], strict=True):
            own[np.frombuffer(at, "<u4")] += np.frombuffer(n, "<f8")
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "n": [own.astype("<f8").tobytes()]})

    found = vocab.select("letters", "widths", "c").mapInArrow(run, "chunk long, at binary, n binary").groupBy("chunk").applyInPandas(add, "chunk long, n binary").toPandas()  # CHUNKS rows
    counts = np.zeros(part * CHUNKS)
    for k, n in zip(found["chunk"], found["n"], strict=True):
        counts[k * part : (k + 1) * part] = np.frombuffer(n, "<f8")
    return counts[:total].reshape(-1, 2).astype(np.float32)


class Mixer:
    """Weights by gate, and the adaptive map; start() is the untrained one."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray, refine: np.ndarray | None = None):
        self.short = counts
        self.stretch = np.log((counts[:, 1] + DELTA) / (counts[:, 0] + DELTA)).astype(np.float32)
        self.weights, self.refine = weights, refine

    @staticmethod
    def start() -> np.ndarray:
        w = np.zeros((N_GATES, N_INPUTS))
        for g in range(N_GATES):
            sure = (g // 2) / len(LEVELS)
            w[g] = (0.1 * (1 - sure), 0.25 * (1 - sure), 0.5 * (1 - sure), 0.2 + 0.8 * sure, 0)
        return w

    def inputs(self, column: tuple, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions (beginnings, N_INPUTS) and gates. leave_out: the word's own
        occurrence is taken out of the longest context."""
        depth, _, _, bit, slots, run, c = column
        if depth < 40:
            pair = self.short[slots[3]].astype(float)
            n0, n1 = pair[:, 0], pair[:, 1]
        else:
            n1 = np.bincount(run, c * bit)[run]
            n0 = np.bincount(run, c * (1 - bit))[run]
        if leave_out:
            n1, n0 = np.maximum(0, n1 - bit), np.maximum(0, n0 - (1 - bit))
        x = np.empty((len(bit), N_INPUTS))
        for t in range(3):
            x[:, t] = self.stretch[slots[t]]
        x[:, 3] = np.log((n1 + DELTA) / (n0 + DELTA))
        x[:, 4] = 0.3
        return x, 2 * np.searchsorted(LEVELS, n0 + n1, "right") + (depth % 8 == 0)

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -16, 16)

    def probability(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Of a one: the mix, and what the adaptive map has seen after such a mix."""
        p = 1 / (1 + np.exp(-z))
        if self.refine is not None:
            at = (np.clip(z, -8, 8) + 8) * (BUCKETS - 1) / 16
            lo = np.minimum(at.astype(int), BUCKETS - 2)
            f = at - lo
            seen = self.refine[gate, lo] * (1 - f) + self.refine[gate, lo + 1] * f
            p = np.where(np.abs(z) < 8, (p + seen) / 2, p)
        return np.clip(p, 1e-7, 1 - 1e-7)


def learn(vocab: DataFrame, counts: np.ndarray, sweeps: int = 2, rate: float = 0.03) -> Mixer:
    """Weights learnt online in each partition and averaged; the map from their predictions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(counts, Mixer.start())
        mass, seen, ones = np.zeros(N_GATES), np.zeros((N_GATES, BUCKETS)), np.zeros((N_GATES, BUCKETS))
        for bits in _trained(batches):
            lot = []  # inputs do not change from sweep to sweep
            for column in bits.columns():
                x, gate = mixer.inputs(column, True)
                lot.append((x.astype(np.float32), gate.astype(np.int16), column[3].astype(np.int8), column[6]))
            for sweep in range(sweeps + 1):
                for x, gate, bit, n in lot:
                    z = mixer.mix(x, gate)
                    if sweep < sweeps:
                        error = (bit - 1 / (1 + np.exp(-z))) * n
                        of = np.bincount(gate, n, N_GATES)
                        for k in range(N_INPUTS):
                            mixer.weights[:, k] += rate * np.bincount(gate, error * x[:, k], N_GATES) / np.maximum(of, 1e-9)
                        mass += of
                    else:
                        at = gate.astype(int) * BUCKETS + np.rint((np.clip(z, -8, 8) + 8) * (BUCKETS - 1) / 16).astype(int)
                        seen += np.bincount(at, n, seen.size).reshape(seen.shape)
                        ones += np.bincount(at, n * bit, seen.size).reshape(seen.shape)
        rows = np.concatenate([(mixer.weights * mass[:, None]).ravel(), mass, seen.ravel(), ones.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(rows)], names=["at", "v"])

    found = vocab.select("letters", "widths", "c").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # as many rows as parameters
    a, b = N_GATES * N_INPUTS, N_GATES * BUCKETS
    v = np.zeros(a + N_GATES + 2 * b)
    v[found["at"]] = found["v"]
    mass = v[a : a + N_GATES, None]
    weights = np.where(mass > 0, v[:a].reshape(N_GATES, N_INPUTS) / np.maximum(mass, 1e-9), Mixer.start())
    seen, ones = v[a + N_GATES : a + N_GATES + b].reshape(N_GATES, BUCKETS), v[a + N_GATES + b :].reshape(N_GATES, BUCKETS)
    prior = 1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS)))
    return Mixer(counts, weights, (ones + 20 * prior) / (seen + 20))


def code_lengths(vocab: DataFrame, mixer: Mixer) -> DataFrame:
    """(bucket, seen, spelled): how often each key was seen in training, -1 less that for what
    is no token of its own, and log10 of its probability, 0 for what is not spelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            keys, at = _spelled(row)
            c, in_all = numbers_of(row["c"]), numbers_of(row["in_all"])
            total, spelled = np.zeros(len(c)), np.zeros(len(at))
            for lot in _lots(keys):
                bits = _Bits(keys[lot], c[at[lot]])
                own = np.zeros(len(keys[lot]))
                for column in bits.columns():
                    _, live, first, bit, _, _, _ = column
                    x, gate = mixer.inputs(column, False)
                    p = mixer.probability(mixer.mix(x, gate), gate)
                    own[live] += np.repeat(np.log10(np.where(bit == 1, p, 1 - p)), np.diff(first, append=len(live)))
                spelled[lot.start + bits.order] = own
            total[at] = spelled
            token = np.array([is_token(k) for k in _split(unpacked(row["letters"]), numbers_of(row["widths"]))], bool)
            yield _binary([{"bucket": row["bucket"], "seen": packed(np.where(token, in_all, -1 - in_all)), "spelled": packed(total.astype("<f4").tobytes())}], SCORED)

    return vocab.select("bucket", "letters", "widths", "c", "in_all").mapInArrow(run, _schema(SCORED))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens_a_block: int = 1_000_000) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), a row
    a row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = saved(blocks(rows, tokens_a_block), "blocks")
    classes, buckets = find_classes(texts), 32 + texts.count() // 2
    vocab = saved(vocabulary(texts, classes, buckets), "vocabulary")
    words = vocab.where("of = -1")
    n_train, v_train = words.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("v_train"), F.lit(0))).first()
    mixer = learn(words, short_contexts(words))
    answers = word_answers(vocab, saved(code_lengths(words, mixer), "scored")).unionAll(pair_answers(texts, 32 + 2 * buckets))

    id_type = rows.schema["id"].dataType
    id_arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(id_type.simpleString(), pa.string())
    prior = np.log10(classes.prior)

    def total(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        t = _Texts(row)
        classes_of, own, key, order = t.classed(classes)
        seen, spelled = np.zeros(len(own)), np.zeros(len(own))
        of = bucket_of(own, buckets)
        by = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[by], np.arange(buckets + 1))
        sums = []
        for a in sorted(answers.to_pylist(), key=lambda a: a["bucket"]):
            if a["is_pair"]:
                sums.append(numbers_of(a["seen"]))
                continue
            at = by[starts[a["bucket"]] : starts[a["bucket"] + 1]]
            seen[at] = numbers_of(a["seen"])
            spelled[at] = np.ascontiguousarray(np.frombuffer(unpacked(a["spelled"]), np.uint8).reshape(4, -1).T).view("<f4").ravel()
        _, pair, _ = t.pairs()
        n_docs = len(t.ids)
        base = np.where(seen >= 0, np.log10((np.maximum(seen, 0) + 0.5) / (n_train + 0.5 * (v_train + 1))), 0)
        lengths = t.lengths
        place, train = np.repeat(np.arange(n_docs), lengths), np.repeat(t.train, lengths)
        n = np.where(seen >= 0, seen, -1 - seen)[before(order, lengths)]
        c, p = np.concatenate(sums)[pair].astype(float), spelled[order]
        scores = np.stack([prior[classes_of] + np.bincount(place, mixed(c, n, p, k), n_docs) for k in STRENGTHS], 1)
        # the block's sums with each training occurrence left out, in its first row
        left_out = [[float(mixed(c[train] - 1, n[train] - 1, p[train], k).sum()) for k in STRENGTHS], *[None] * (n_docs - 1)]
        columns = [pa.array(t.ids, id_arrow), *(pa.array(np.bincount(t.doc, t.times * x[key], n_docs)) for x in (seen >= 0, seen > 0, base))]
        lists = pa.list_(pa.float64())
        return pa.Table.from_arrays([*columns, pa.array(numbers_of(row["n_bytes"])), pa.array(list(scores), lists), pa.array(left_out, lists)], names=["id", "token", "known", "base", "n_bytes", "spelled", "left_out"])

    sums = texts.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(total, f"id {id_type.simpleString()}, token double, known double, base double, n_bytes long, spelled array<double>, left_out array<double>")
    sums = saved(sums, "sums")
    left_out = sums.where("left_out IS NOT NULL").agg(*(F.coalesce(F.sum(F.get("left_out", F.lit(k))), F.lit(0.0)) for k in range(len(STRENGTHS)))).first()
    best = int(np.argmax(left_out))
    held = F.coalesce(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 5 == 1, F.lit(False))
    score = F.get("spelled", F.lit(best))
    return sums.select(
        F.col("id").alias(id_col), held.alias("held_out"), F.col("token").cast("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score"), (-score * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op9_context_mixing_lm(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
