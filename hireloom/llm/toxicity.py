"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the embeddings of its character n-grams (3 to 6 bytes of
the lower-cased word between two blanks) and of itself, all hashed into one table; a
passage's vector is the mean of its words', short ones padded with neutral words; two
softmax weights make it the probability of the toxic class. Table and softmax are trained
jointly in numpy. A misspelling nobody has seen shares most n-grams with what it misspells.

Labels are of documents, but what is toxic is a passage. So the rounds of training choose
from each toxic document the passage that is most toxic so far (the first time: random
ones), and from each clean document random ones and the most toxic one, which is a mistake
to be mended. A document's value is that of its most toxic passage; a logistic curve
fitted to the training documents makes it the score.

The classifier is fitted in the driver on a bounded sample: `sample` documents of either
class, first by the hash of their ids, of at most `most_bytes` bytes each. Everything else
covers whole texts of all rows: tasks go through texts in pieces of `piece` bytes that
share the words of a passage, and need memory for one piece only besides the text.

Cases: a null or empty text has one passage of no words, and is scored as such. Equal
texts get equal scores. An id whose labels differ is toxic; repeated ids of documents are
scored row by row, and those of null id are not held out. Without labelled rows of both
classes every score is 0. Columns other than the named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, table

LENGTHS = (3, 4, 5, 6)
BITS, WIDTH = 18, 8
#: Documents of the sample in which a feature must occur to have a vector.
LEAST_DOCS = 5
#: Words of a passage, and from the start of one to that of the next.
PASSAGE, STEP = 10, 5
_PRIME = np.uint64(1_099_511_628_211)
_INVERSE = np.uint64(pow(1_099_511_628_211, -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29)) ^ np.uint64(salt)) * _MIX
    return ((h ^ (h >> np.uint64(32))) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


class Words:
    """The words of a buffer (blank at both ends): where they are and their features' buckets."""

    def __init__(self, data: np.ndarray) -> None:
        self.blank = _BLANK[data]
        self.data = np.where(self.blank, 32, data).astype(np.uint64)
        edge = np.flatnonzero(np.diff(self.blank))
        self.start, self.end = edge[::2] + 1, edge[1::2] + 1  # end exclusive
        self.owner = np.cumsum(self.blank[:-1] & ~self.blank[1:])  # at i: 1 + the word of byte i + 1

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, bucket) of all n-grams of one length after the other, then of whole words."""
        h = self.data * _PRIME + np.append(self.data[1:], np.uint64(0))
        inner = ~self.blank  # n-grams from i whose bytes i + 1 to i + n - 2 are in one word
        inner = np.append(inner[1:], False)
        for n in range(3, max(LENGTHS) + 1):
            m = len(self.data) - n + 1
            if m <= 0:
                break
            h = h[:m] * _PRIME + self.data[n - 1 :]
            if n > 3:
                inner = inner[:m] & ~self.blank[n - 2 : n - 2 + m]
            if n in LENGTHS:
                at = np.flatnonzero(inner[:m])
                yield self.owner[at] - 1, _bucket(h[at], n)
        power = np.cumprod(np.full(len(self.data) + 1, _INVERSE))  # falling powers of the prime
        sums = np.append(np.uint64(0), np.cumsum(self.data * power[:-1]))
        back = np.cumprod(np.full(len(self.data) + 1, _PRIME))
        yield np.arange(len(self.start)), _bucket((sums[self.end] - sums[self.start]) * back[self.start], 1)


def _data(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode("utf-8", "replace") + b" "


def _windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, end) of the passages of documents with so many words each."""
    count = np.maximum(0, -(-(words - PASSAGE) // STEP)) + 1
    doc = np.repeat(np.arange(len(words)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    base = np.cumsum(words) - words
    first = base[doc] + nth * STEP
    return doc, first, np.minimum(first + PASSAGE, base[doc] + words[doc])


def word_scores(words: Words, u: np.ndarray) -> np.ndarray:
    """Mean over a word's features of u, a number a bucket."""
    n = len(words.start)
    total, count = np.zeros(n), np.zeros(n)
    for word, bucket in words.features():
        total += np.bincount(word, u[bucket], n)
        count += np.bincount(word, minlength=n)
    return total / np.maximum(count, 1)


def best_passages(texts: list[bytes], u: np.ndarray, bias: float, piece: int) -> np.ndarray:
    """The largest passage value of each text (blank at both ends)."""
    out = np.full(len(texts), -np.inf)
    lot: list[tuple[int, bytes]] = []

    def flush() -> None:
        if not lot:
            return
        size = np.array([len(b) for _, b in lot])
        words = Words(np.frombuffer(b"".join(b for _, b in lot), np.uint8))
        of = np.searchsorted(np.cumsum(size), words.start, "right")
        doc, first, end = _windows(np.bincount(of, minlength=len(lot)))
        sums = np.append(0, np.cumsum(word_scores(words, u)))
        np.maximum.at(out, np.array([k for k, _ in lot])[doc], bias + (sums[end] - sums[first]) / PASSAGE)
        lot.clear()

    held = 0
    for k, text in enumerate(texts):
        for part in _pieces(text, piece):
            if held + len(part) > piece:
                flush()
                held = 0
            lot.append((k, part))
            held += len(part)
    flush()
    return out


def _pieces(text: bytes, piece: int) -> Iterator[bytes]:
    """Parts of at least `piece` bytes that end at blanks, each with the last words of the one before."""
    at, tail = 0, b" "
    while len(text) - at > piece:
        end = at + piece
        cut = min((c for c in (text.find(b, end) for b in (b" ", b"\n")) if c >= 0), default=len(text) - 1)
        part = text[at:cut]
        yield tail + part + b" "
        tail = b" " + b" ".join((tail + part).rsplit(None, PASSAGE - 1)[-PASSAGE + 1 :]) + b" "
        at = cut
    yield text if not at else tail + text[at:]


class _Sample:
    """The passages of the training documents as rows of word numbers, words as lists of buckets."""

    def __init__(self, texts: list[str | None], toxic: np.ndarray) -> None:
        self.toxic = toxic
        known: dict[bytes, int] = {}
        rows = [np.array([known.setdefault(w, len(known)) for w in _data(t).split()], np.int64) for t in texts]
        vocabulary = Words(np.frombuffer(b" " + b" ".join(known) + b" ", np.uint8))
        word, bucket = map(np.concatenate, zip(*vocabulary.features(), strict=True))
        order = np.argsort(word, kind="stable")
        word, bucket = word[order], bucket[order]
        self.size = np.bincount(word, minlength=len(known))
        # A feature of few documents says which document it is, not what it says.
        common = self._documents(rows, word, bucket) >= LEAST_DOCS
        word, self.bucket = word[common[bucket]], bucket[common[bucket]]
        self.count = np.bincount(word, minlength=len(known))
        self.begin = np.cumsum(self.count) - self.count
        self.words = np.concatenate(rows)
        self.doc, self.first, self.end = _windows(np.array([len(r) for r in rows]))
        self.word_of = word

    @staticmethod
    def _documents(rows: list[np.ndarray], word: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """In how many documents each bucket occurs."""
        begin = np.searchsorted(word, np.arange(word[-1] + 2 if len(word) else 1))
        out = np.zeros(1 << BITS, np.int64)
        for row in rows:
            some = np.unique(row)
            each = begin[some + 1] - begin[some]
            out[np.unique(bucket[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin[some], each)])] += 1
        return out

    def values(self, u: np.ndarray, bias: float) -> np.ndarray:
        scores = np.bincount(self.word_of, u[self.bucket], len(self.count)) / np.maximum(self.size, 1)
        sums = np.append(0, np.cumsum(scores[self.words]))
        return bias + (sums[self.end] - sums[self.first]) / PASSAGE

    def firsts(self, key: np.ndarray, k: int) -> np.ndarray:
        """The k windows of least key of each document."""
        order = np.lexsort((key, self.doc))
        doc = self.doc[order]
        return order[np.arange(len(doc)) - np.searchsorted(doc, doc) < k]

    def take(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window's place, bucket, weight) of all features of the windows' words."""
        many = self.end[windows] - self.first[windows]
        place = np.repeat(np.arange(len(windows)), many)
        word = self.words[np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[windows], many)]
        each = self.count[word]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(self.begin[word], each)
        return np.repeat(place, each), self.bucket[at], np.repeat(1 / (self.size[word] * PASSAGE), each)


def train(texts: list[str | None], toxic: np.ndarray, rounds: int = 8, epochs: int = 2, batch: int = 128, rate: float = 0.3, seed: int = 7) -> tuple[np.ndarray, float, float, float]:
    """(u, bias, slope, offset): a number a bucket and the bias of a passage's value, and
    the logistic curve from a document's largest value to its score."""
    rng, s = np.random.default_rng(seed), _Sample(texts, toxic)
    e, w, bias = np.zeros((1 << BITS, WIDTH)), rng.normal(0, 0.5, (2, WIDTH)), np.zeros(2)
    used = np.unique(s.bucket)
    e[used] = rng.normal(0, 0.05, (len(used), WIDTH))
    seen_e, seen_w, seen_b = np.full(1 << BITS, 1e-4), np.full(2, 1e-4), 1e-4
    toxic_window = toxic[s.doc]
    for turn in range(rounds):
        value = s.values(e @ (w[1] - w[0]), bias[1] - bias[0])
        noise = rng.random(len(value))
        plain, worst = s.firsts(noise, 4 if turn else 16), s.firsts(-value, 1)
        clean = [plain[~toxic_window[plain]]] + ([worst[~toxic_window[worst]]] if turn else [])
        marked = worst if turn else plain
        pool = np.concatenate([*clean, marked[toxic_window[marked]]])
        balance = np.where(toxic_window[pool], len(pool) / (2 * max(1, toxic_window[pool].sum())), len(pool) / (2 * max(1, (~toxic_window[pool]).sum())))
        for _ in range(epochs):
            mixed = rng.permutation(len(pool))
            for at in range(0, len(mixed), batch):
                some = mixed[at : at + batch]
                place, bucket, weight = s.take(pool[some])
                # Half of the features are left out, so that no spelling is learnt as a whole.
                on = rng.random(len(place)) < 0.5
                place, bucket, weight = place[on], bucket[on], 2 * weight[on]
                h = np.zeros((len(some), WIDTH))
                order = np.searchsorted(place, np.arange(len(some)))
                full = np.flatnonzero(np.bincount(place, minlength=len(some)))
                if len(place):
                    h[full] = np.add.reduceat(e[bucket] * weight[:, None], order[full])
                z = h @ w.T + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(some)), toxic_window[pool[some]].astype(int)] -= 1
                p *= balance[some, None] / len(some)
                back = p @ w
                dw, db = p.T @ h, p.sum(0)
                hit, where = np.unique(bucket, return_inverse=True)
                de = np.stack([np.bincount(where, back[place, k] * weight, len(hit)) for k in range(WIDTH)], 1)
                seen_e[hit] += (de * de).mean(1)
                e[hit] -= rate * de / np.sqrt(seen_e[hit])[:, None]
                seen_w += (dw * dw).mean(1)
                w -= rate * dw / np.sqrt(seen_w)[:, None]
                seen_b += (db * db).mean()
                bias -= rate * db / np.sqrt(seen_b)
    u, b = e @ (w[1] - w[0]), float(bias[1] - bias[0])
    value = s.values(u, b)
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, s.doc, value)
    return u, b, *_curve(top, toxic)


def _curve(value: np.ndarray, toxic: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve, classes weighted alike, by damped Newton steps."""
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    x = np.stack([value, np.ones_like(value)], 1)
    at, target = np.array([1.0, 0.0]), np.where(toxic, 0.99, 0.01)  # so that separable classes have a finite curve
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        at = at - np.clip(np.linalg.solve(hessian, x.T @ (weight * (p - target))), -1, 1)
    return float(max(at[0], 1e-3)), float(at[1])


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, most_bytes: int) -> tuple[list[str | None], np.ndarray]:
    """Texts and labels of the sample; labels of the held-out fold (remainder 0) are not read."""
    known = labels.where((fold(id_col) != 0) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("toxic"))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    there = slim.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes).select("id")
    known = known.join(there, "id", "left_semi")
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(sample).collect() for k in (0, 1)]  # sample rows each
    if not all(parts):
        return [], np.zeros(0, bool)
    chosen = docs.sparkSession.createDataFrame([r for part in parts for r in part], known.schema)
    # Repeated ids of documents can't make it larger either.
    rows = slim.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes).join(F.broadcast(chosen), "id")
    rows = rows.orderBy(F.xxhash64("id"), "id", "text").limit(2 * sample).collect()
    return [r["text"] for r in rows], np.array([r["toxic"] == 1 for r in rows])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 1500, most_bytes: int = 16_384, piece: int = 1 << 19) -> DataFrame:
    """(id_col, held_out, score): see the module."""
    texts, toxic = training_sample(docs, labels, id_col, text_col, label_col, sample, most_bytes)
    held_out = F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out")
    if not toxic.any() or toxic.all():
        return docs.select(F.col(id_col).alias(id_col), held_out, F.lit(0.0).alias("score"))
    u, bias, slope, offset = train(texts, toxic)
    model = docs.sparkSession.sparkContext.broadcast(u)  # 2^18 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                z = best_passages([_data(t) for t in part.column(1).to_pylist()], model.value, bias, piece)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(slope * z + offset, -700, 700))))], names=[id_col, "score"])

    slim = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    scored = slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, score double")
    return scored.select(id_col, held_out, "score")


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
