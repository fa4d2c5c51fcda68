"""Canonical exact digests of documents, in DataFrame and SQL functions alone.

A text is brought to a canonical form (Unicode NFKC, full case folding, NFKC
again, every run of Unicode white space one blank, none at the ends) and hashed
to 128 bits of xxhash. Texts whose digests are equal form a bucket; inside
buckets the canonical forms themselves are compared, by least and greatest, which
Spark combines before the shuffle, so a bucket of any size is two texts a task.
Forms whose digest occurs once are compared with nothing and not sent anywhere.
Texts of a bucket that do differ get the SHA-256 of their form appended.

The query also fingerprints edited texts, which exist only after the next document
has been met. These join the buckets by SHA-256: an edited text that shares a digest
with a different form, edited or not, is told apart by it, not by its bytes, as
sending every edited text once more would double what is shuffled.

A null text is an empty one, and all empty texts share a fingerprint. Repeated
rows have equal fingerprints. Ids can be of any type that has an order; a null id
comes last. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table


def canonical(text: Column) -> Column:
    """NFKC and case folding by ICU's static functions, then white space."""
    icu = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), icu(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.btrim(F.regexp_replace(icu(folded), r"(?U)\s+", " "))


def digest(form: Column) -> Column:
    """128 bits of xxhash as 32 hexadecimal digits."""
    half = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(half(F.xxhash64(form)), half(F.xxhash64(F.lit("second"), form)))


def collisions(forms: DataFrame) -> DataFrame:
    """Digests under which different canonical forms meet; forms has digest and form."""
    ends = forms.groupBy("digest").agg(F.min("form").alias("lo"), F.max("form").alias("hi"))
    return ends.where(F.col("lo") != F.col("hi")).select("digest")


def repeated(digests: DataFrame, share: int = 1000) -> DataFrame:
    """The rows of digests (with digest) whose digest occurs more than once.

    Digests of more than 1/share of all rows, share of them at most, are met by
    broadcast, so the shuffled join has no hot key.
    """
    counts = saved(digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    total = digests.count()
    hot = counts.where(F.col("n") * share > total).select("digest", F.lit(True).alias("hot"))
    marked = digests.join(F.broadcast(hot), "digest", "left")
    rest = marked.where("hot IS NULL").join(counts.where(F.col("n") * share <= total), "digest", "left_semi")
    return rest.unionByName(marked.where("hot")).drop("hot")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint): equal exactly where canonical forms are equal."""
    forms = docs.select(F.col(id_col).alias(id_col), canonical(F.col(text_col)).alias("form")).withColumn("digest", digest(F.col("form")))
    clash = collisions(forms).withColumn("clash", F.lit(True))
    out = forms.select(id_col, "digest", F.sha2("form", 256).alias("sha")).join(clash, "digest", "left")
    return out.select(id_col, _name("digest", "sha", "clash").alias("fingerprint"))


def _name(digest_col: str, sha: str, clash: str) -> Column:
    return F.when(F.col(clash), F.concat_ws("-", digest_col, sha)).otherwise(F.col(digest_col))


def _ranges(ids: DataFrame, rows_a_range: int, most: int = 32_768) -> list[list]:
    """The least ids of ranges with about so many ids each (most ranges at most), as a list
    of lists of about the root of their number; Spark's range partitioning finds them."""
    ids = ids.where("id IS NOT NULL")
    n = max(1, min(most, ids.count() // rows_a_range))
    dealt = ids.repartitionByRange(n, "id").withColumn("range", F.spark_partition_id())
    least = dealt.groupBy("range").agg(F.min("id").alias("id")).agg(F.to_json(F.sort_array(F.collect_list("id")))).first()[0]
    least = json.loads(least)[1:]  # what is less than the second range's least is the first
    size = max(1, int(len(least) ** 0.5))
    return [least[k : k + size] for k in range(0, len(least), size)]


def _range_of(c: Column, ranges: list[list], id_type: str) -> Column:
    """The number of the range of an id: how many leasts it reaches; -1 for a null id."""
    if not ranges:
        return F.when(c.isNull(), -1).otherwise(0)
    heads = F.from_json(F.lit(json.dumps([r[0] for r in ranges])), f"array<{id_type}>")
    group = F.size(F.filter(heads, lambda h: h <= c))
    own = F.get(F.from_json(F.lit(json.dumps(ranges)), f"array<array<{id_type}>>"), group - 1)
    return F.when(c.isNull(), -1).when(group == 0, 0).otherwise((group - 1) * len(ranges[0]) + F.size(F.filter(own, lambda h: h <= c))).cast("int")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_a_range: int = 5000, marks: DataFrame | None = None) -> DataFrame:
    """(id_col, text, next_text, marked): the next document by descending id, after the last
    the first; marked tells whether marks holds the id.

    Ids are dealt to ranges; a range's last document takes the greatest of the next
    lower range, which is sent there as a guest. Texts are shuffled once, marks meet
    them there, and no group is larger than a range.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    ids = docs.select(F.col(id_col).alias("id"))
    ranges = _ranges(ids, rows_a_range)
    of = _range_of(F.col("id"), ranges, id_type)
    heads = ids.groupBy(of.alias("b")).agg(F.max("id").alias("head"))
    # a row a range: the one that comes before this one, for the first the last
    down = Window.orderBy(F.desc("b"))
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sent = heads.select("b", "head", F.coalesce(F.lag("b").over(down), F.last("b").over(whole)).alias("to"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("b", of)
    # of rows that share the greatest id the first in the order below is the guest
    joined = rows.join(F.broadcast(sent), "b")  # a row a range
    place = lambda b, guest: F.struct(F.col(b).alias("b"), F.lit(guest).alias("guest"))
    places = F.when(F.col("id").eqNullSafe(F.col("head")), F.array(place("b", False), place("to", True))).otherwise(F.array(place("b", False)))
    dealt = joined.select("id", "text", F.explode(places).alias("p")).select("id", "text", "p.b", "p.guest", F.lit(1).alias("is_text"), F.xxhash64("text").alias("h"))
    if marks is not None:
        dealt = dealt.unionByName(marks.select(F.col(id_col).alias("id"), F.lit(None).cast("string").alias("text"), of.alias("b"), F.lit(False).alias("guest"), F.lit(0).alias("is_text"), F.lit(None).cast("bigint").alias("h")))
    order = "(PARTITION BY b ORDER BY guest, id DESC NULLS LAST, is_text, h)"
    last = F.expr(f"last(CASE WHEN is_text = 0 THEN struct(id) END) IGNORE NULLS OVER {order}")
    out = dealt.select("id", "text", "guest", F.expr(f"lead(text) IGNORE NULLS OVER {order}").alias("next_text"), last.alias("mark")).where("NOT guest AND text IS NOT NULL")
    marked = F.col("mark").isNotNull() & F.col("mark.id").eqNullSafe(F.col("id"))
    return out.select(F.col("id").alias(id_col), "text", F.coalesce("next_text", "text").alias("next_text"), marked.alias("marked"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    seen = saved(docs.select(F.col(id_col).alias(id_col), digest(canonical(F.col(text_col))).alias("digest")), "digests")
    pairs = with_next(docs, id_col, text_col, marks=repeated(seen).select(id_col).distinct())
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    forms = pairs.select(id_col, "marked", n.cast("long").alias("n_chars"), edited.alias("edited"), canonical(F.col("text")).alias("form"), canonical(edited).alias("edited_form"), canonical(F.col("next_text")).alias("next_form"))
    like = lambda a: ((digest(F.col("form")) == digest(F.col(a))) & (F.col("form") == F.col(a))).cast("double")  # noqa: E731  equal digests, then bytes
    rows = forms.select(
        id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("form")).alias("digest"), F.sha2("form", 256).alias("sha"),
        digest(F.col("edited_form")).alias("edited_digest"), F.sha2("edited_form", 256).alias("edited_sha"), like("edited_form").alias("near_edited"), like("next_form").alias("near_next"),
        F.when(F.col("marked"), F.col("form")).alias("form"),
    )
    rows = saved(rows, "digests")
    clash = collisions(rows.where("form IS NOT NULL"))
    shas = rows.select("digest", F.col("sha").alias("form")).unionAll(rows.select(F.col("edited_digest").alias("digest"), F.col("edited_sha").alias("form")))
    clash = saved(clash.unionAll(collisions(shas)).distinct(), "collisions")
    out = rows.join(clash.withColumn("clash", F.lit(True)), "digest", "left")
    out = out.join(clash.select(F.col("digest").alias("edited_digest"), F.lit(True).alias("edited_clash")), "edited_digest", "left")
    return out.select(id_col, "n_chars", "edited_sha256", _name("digest", "sha", "clash").alias("fingerprint"), _name("edited_digest", "edited_sha", "edited_clash").alias("edited_fingerprint"), "near_edited", "near_next")


def op8_document_fingerprint(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
