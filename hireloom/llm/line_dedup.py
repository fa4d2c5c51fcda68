"""Line de-duplication within an edit bound of one, by deletion neighbourhoods.

A line takes part if its trimmed, lower-cased form has min_chars characters at
least, one as a rule: only blank lines are always kept. Of equal forms the earliest
line (by document id, then place; null ids first) stays. Of forms with near_chars
characters and more, one also goes if an earlier one is one edit away (in shorter
lines an edit often makes another word):

* all forms with one character deleted are emitted as hashed keys, from prefix and
  suffix hashes, so a line costs its length;
* forms of equal length meet under (place, rest): they differ in that place alone, so
  comparing with the earliest of a key is comparing with all;
* a form with one character more meets the shorter one under the shorter's own hash,
  of which there is one. No key ever needs pairs of its members;
* the edit distance of what met is verified on the texts.

Most lines have no such neighbour. One edit leaves the first or the last half of a
line as it was, so only lines that share (length, half) with another form emit
their neighbourhoods; this filter loses nothing. Their texts are fetched by a second
reading of the documents, which sends on the lines whose hash has its bit in a filter
of fixed size, not the documents.

Lines are told apart by 128-bit hashes. Equal lines are combined before the
shuffle, and what is sent back to documents is the lines to keep, each of which
exists once, so a line in every document is as cheap as any other.

A null text stays null and an empty one empty. Rows with equal ids and texts count
as one document; of rows with one id and different texts each line is its own. An
empty table gives an empty result. All columns are passed through, but for those
named like the two that are added (a parameter), which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, saved, table

_P = np.uint64(0x9E3779B97F4A7C15)

#: Fixed value: words of 64 bits in the filter by which lines are told that may have a near one.
WORDS = 2**19


def _form(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\r\x0b\x0c")))


def _lines(text: Column) -> Column:
    """array<struct<no, form>> of all lines."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("no"), _form(x).alias("form")))


def _numbered(text: Column, min_chars: int) -> Column:
    """array<struct<no, form>> of the lines that take part."""
    return F.filter(_lines(text), lambda x: F.length(x["form"]) >= min_chars)


def _place(no: Column, h1: Column) -> Column:
    """A line's number in its document, in the low 31 bits, under bits of its hash: so sets of
    lines are sets of numbers, which Spark intersects by hashing."""
    return F.shiftleft(h1, 31).bitwiseOR(no.cast("bigint"))


def _number(place: Column) -> Column:
    return place.bitwiseAND(F.lit(2**31 - 1)).cast("int")


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once, also where body is evaluated for each line."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _neighbourhood(form: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the form without each character, those with the place mixed in, its own."""
    c = np.frombuffer(form.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(c)
    c = (c * np.uint64(0xD6E8FEB86659FD93)) ^ (c << np.uint64(29))
    power = np.ones(n + 1, np.uint64)
    power[1:] = np.cumprod(np.full(n, _P), dtype=np.uint64)
    # sum of c[i] * P^i, all modulo 2^64; what stands after a deletion moves down one power
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(c * power[:n], dtype=np.uint64)])
    lower = np.concatenate([[np.uint64(0)], np.cumsum(c[1:] * power[: n - 1], dtype=np.uint64)])
    without = prefix[:n] + (lower[n - 1] - lower[np.arange(n)])
    mix = lambda h, salt: (lambda x: x ^ (x >> np.uint64(32)))((h ^ (h >> np.uint64(31)) ^ salt) * np.uint64(0xD6E8FEB86659FD93))
    plain = mix(without, np.uint64(n - 1))
    placed = mix(without + (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407), np.uint64(2**40 + n))
    return plain, placed, int(mix(prefix[n : n + 1], np.uint64(n))[0])


def neighbourhoods(lines: DataFrame) -> DataFrame:
    """lines (first, form) to (first, key, kind): kind 0 is the form itself, 1 a form with
    a character deleted, 2 the same with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows, keys, kinds = [], [], []
                for k, form in enumerate(part.column(1).to_pylist()):
                    plain, placed, own = _neighbourhood(form)
                    plain = np.unique(plain)
                    keys += [np.array([own], np.uint64), plain, placed]
                    kinds += [np.repeat(np.array([0, 1, 2], np.int8), [1, len(plain), len(placed)])]
                    rows += [np.full(1 + len(plain) + len(placed), k)]
                if rows:
                    first = part.column(0).take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([first, pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(kinds))], names=["first", "key", "kind"])

    kind = lines.schema["first"].dataType.simpleString()
    return lines.select("first", "form").mapInArrow(run, f"first {kind}, key long, kind tinyint")


def _bits(wanted: DataFrame) -> DataFrame:
    """(word, bits): a bit for each hash of wanted, in WORDS words at most however many there are."""
    return wanted.groupBy(_word(F.col("h1")).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("h1")))).alias("bits"))


def _word(h1: Column) -> Column:
    return F.shiftrightunsigned(h1, 6).bitwiseAND(F.lit(WORDS - 1))


def _bit(h1: Column) -> Column:
    return h1.bitwiseAND(F.lit(63)).cast("int")


def _forms(ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """(first, form) of the lines (first, h1) of wanted, from ids (id, x). Most lines are left out
    where they are read, by a bit of their hash; those that share a bit by chance, by the join."""
    rows = ids.select(F.struct("id", "x.no").alias("first"), F.xxhash64("x.form").alias("h1"), F.col("x.form").alias("form"))
    likely = rows.join(F.broadcast(_bits(wanted)), (_word(F.col("h1")) == F.col("word")) & (F.getbit("bits", _bit(F.col("h1"))) == 1), "left_semi")
    asked = wanted.select(F.col("first").alias("f"), F.col("h1").alias("g"))
    return likely.join(asked, F.expr("h1 = g AND first <=> f"), "left_semi").select("first", "form").distinct()


def _near_earlier(lines: DataFrame) -> DataFrame:
    """The lines (first, form) with an earlier line one edit away."""
    keys = neighbourhoods(lines)
    group = Window.partitionBy("key", F.col("kind") == 2)
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("first"))).over(group)
    met = keys.select("first", "kind", *(least(k).alias(f"least{k}") for k in (0, 1, 2)))
    by = F.when(F.col("kind") == 0, F.col("least1")).when(F.col("kind") == 1, F.col("least0")).otherwise(F.col("least2"))
    pairs = met.withColumn("by", by).where("by < first").select("first", "by").distinct()
    a, b = lines.select("first", "form"), lines.select(F.col("first").alias("by"), F.col("form").alias("other"))
    met = pairs.alias("p").join(a.alias("a"), F.expr("p.first <=> a.first")).join(b.alias("b"), F.expr("p.by <=> b.by"))
    return met.where(F.levenshtein("form", "other", 1) == 1).select("p.first", "form").distinct()


def dedup_lines(docs: DataFrame, min_chars: int = 1, near_chars: int = 32, max_edits: int = 1, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("_hl_lines", "_hl_dropped")) -> DataFrame:
    """docs with repeated lines taken out of text, and counts: how many lines there were and went."""
    if max_edits not in (0, 1):
        raise ValueError("the edit bound is 0 or 1")
    ids = docs.select(F.col(id_col).alias("id"), F.explode(_numbered(F.col(text_col), min_chars)).alias("x"))
    form, n = F.col("x.form"), F.length("x.form")
    half = lambda size, side: (F.left if side == "p" else F.right)(form, F.floor(size / 2).cast("int"))
    key = lambda size, side: F.when(n >= near_chars, F.xxhash64(size, F.lit(side), half(size, side)))
    rows = ids.select(F.struct("id", "x.no").alias("first"), F.xxhash64(form).alias("h1"), F.xxhash64(F.lit("second"), form).alias("h2"), *(key(size, side).alias(f"k{i}") for i, (size, side) in enumerate(((n, "p"), (n, "s"), (n + 1, "p"), (n + 1, "s")))))
    ks = ["k0", "k1", "k2", "k3"]
    firsts = rows.groupBy("h1", "h2", *ks).agg(F.min("first").alias("first"))  # the keys depend on the hashes
    if not max_edits:
        firsts = firsts.drop(*ks)
    firsts = saved(firsts, "lines")
    kept = firsts.select("first", "h1")
    placed = lambda rows: F.transform(rows, lambda x: _place(x["no"], F.xxhash64(x["form"])))
    if max_edits:
        keyed = firsts.where("k0 IS NOT NULL").select("first", "h1", "h2", F.explode(F.array(*ks)).alias("k"))
        shared = keyed.groupBy("k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.min("h2").alias("lo2"), F.max("h2").alias("hi2")).where("lo <> hi OR lo2 <> hi2").select("k")
        wanted = saved(keyed.join(shared, "k", "left_semi").select("first", "h1").distinct(), "wanted")
        lines = saved(_forms(docs.select(F.col(id_col).alias("id"), F.explode(_numbered(F.col(text_col), near_chars)).alias("x")), wanted), "forms")
        near = saved(_near_earlier(lines), "near")
        kept = kept.alias("k").join(near.select(F.col("first").alias("f"), F.xxhash64("form").alias("g")), F.expr("k.first <=> f AND k.h1 = g"), "left_anti")
    of, stay, state = fresh(docs, "_hl_of", "_hl_kept", "_hl_state")
    kept = kept.groupBy(F.col("first.id").alias(of)).agg(F.collect_list(_place(F.col("first.no"), F.col("h1"))).alias(stay))
    out = docs.join(kept, F.col(id_col).eqNullSafe(F.col(of)), "left")
    none = F.array().cast("array<bigint>")

    def resolve(s: Column) -> Column:
        taking = placed(F.filter(s["rows"], lambda x: F.length(x["form"]) >= min_chars))
        blank = placed(F.filter(s["rows"], lambda x: F.length(x["form"]) < min_chars))
        left = F.array_intersect(taking, F.coalesce(s["kept"], none))
        return F.struct(F.size(s["rows"]).alias("n"), (F.size(taking) - F.size(left)).alias("gone"), F.sort_array(F.transform(F.concat(left, blank), _number)).alias("left"))

    out = out.withColumn(state, _bound(F.struct(_lines(F.col(text_col)).alias("rows"), F.col(stay).alias("kept")), resolve))
    joined = _bound(F.struct(F.split(text_col, "\n").alias("parts"), F.col(f"{state}.left").alias("left")), lambda s: F.array_join(F.transform(s["left"], lambda no: F.get(s["parts"], no)), "\n"))
    text = F.when(F.col(f"{state}.gone") > 0, joined).otherwise(F.col(text_col))
    out = out.withColumns({counts[0]: F.when(F.col(text_col).isNull(), 0).otherwise(F.col(f"{state}.n")), counts[1]: F.col(f"{state}.gone"), text_col: text})
    return out.select(*(c for c in docs.columns if c not in counts), *counts)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", F.col("_hl_lines").cast("long").alias("n_lines"), F.col("_hl_dropped").cast("long").alias("n_dropped"))
