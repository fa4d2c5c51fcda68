"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: a share of the whole mix by weight,
water-filled under a cap of so many times the source's own size. A source's
target over its size is the expected number of copies of its words. The whole
part of it is certain: every document is taken that often. For the rest, documents
are ranked by random odds over inclusion odds (Rosen's Pareto order sampling), and
the lowest ranks are taken until the source's remaining words are reached, so the
sample's size is fixed and not binomial. Inclusion odds differ between documents:
the source's remaining share of copies, as odds, times the root of the document's
size over the mean of its source, so that long documents, which hold more of what is
still to be taken, are likelier, but less than in proportion.

The cut-off of a source is found from counts by digits of the rank: three rounds
of 4096 bins each, so a source with a third of all rows is a few thousand rows
of sums and never a sorted partition. The random numbers come from the md5 of
the document id, so reruns agree.

A null text is empty and has size 0; such documents are taken with the rest of
their rank at no cost. A null source is a source of its own, last in order. Rows
with equal ids have equal ranks and are taken or left together. An empty table
gives an empty result. Columns other than id, text and source are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, table

BITS = 12
ROUNDS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), mix: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, documents, target): targets share mix * all words by weight, none
    above cap * its source's size.

    Resharing the excess until none is left ends where one level times the weight,
    or the cap, is each source's target. Sources sorted by cap over weight are
    capped up to a place; the level follows from sums before that place. The one
    window without a partition has a row a source.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (place % len(weights) + 1).cast("int"))
    ranked = sums.select("source", "source_size", "documents", w.alias("w"), (F.col("source_size") * float(cap)).alias("most"))
    up = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * float(mix) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("most"))
    # among the free places the first has the level that holds for all after it
    first = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("most"), F.coalesce(first, F.col("level")) * F.col("w"))
    return leveled.select("source", "source_size", "documents", target.alias("target"))


def uniform(doc_id: Column) -> Column:
    """In (0, 1), from 52 bits of the md5 of the id as text."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), mix: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, source, size, source_size, target, copies): how often each document is taken."""
    sizes = saved(docs.select(F.col(id_col).alias(id_col), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    goals = source_targets(sizes, weights, mix, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.withColumn("rate", rate).withColumn("sure", F.floor(F.col("rate") + 1e-12)).withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("sure")))
    goals = saved(goals.withColumn("rest", F.col("part") * F.col("source_size")), "goals")

    # The rank q = odds(u) / odds of inclusion, held as q / (1 + q) in (0, 1) and cut into digits.
    u, mean = uniform(F.col(id_col)), F.col("source_size") / F.col("documents")
    odds = F.col("part") / (1 - F.col("part")) * F.sqrt(F.greatest(F.col("size"), F.lit(1)) / mean)
    q = (u / (1 - u)) / odds
    key = F.when(F.col("part") > 0, F.least(F.floor(q / (1 + q) * float(2 ** (BITS * ROUNDS))), F.lit(2 ** (BITS * ROUNDS) - 1))).cast("long")
    same = F.expr("d.source <=> g.source")
    ranked = sizes.alias("d").join(goals.alias("g"), same).select(f"d.{id_col}", "d.source", "size", "source_size", "target", "sure", "rest", key.alias("key"))
    ranked = saved(ranked, "ranked")

    # A source's words below a digit's bin are taken; the bin that crosses is looked into.
    state = goals.where("part > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("double").alias("below"))
    for r in range(ROUNDS):
        shift = BITS * (ROUNDS - 1 - r)
        bins = ranked.where(F.col("key").isNotNull()).groupBy("source", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("words"))
        inside = bins.alias("b").join(state.alias("s"), F.expr(f"b.source <=> s.source AND shiftright(b.bin, {BITS}) = s.prefix" if r else "b.source <=> s.source"))
        run = Window.partitionBy("s.source").orderBy("bin")
        upto = F.col("below") + F.sum("words").over(run)
        rows = inside.select("s.source", "rest", "bin", (upto - F.col("words")).alias("below"), upto.alias("upto"))
        crossing = rows.where((F.col("upto") >= F.col("rest")) | F.col("upto").isNull())
        state = saved(crossing.groupBy("source").agg(F.min_by(F.struct("rest", "bin", "below", "upto"), "bin").alias("x")).select("source", "x.rest", F.col("x.bin").alias("prefix"), "x.below", "x.upto"), "cut")
    # The last bin is one rank, as good as always: taken if that comes nearer to the target.
    last = F.when(F.col("upto") - F.col("c.rest") <= F.col("c.rest") - F.col("below"), F.col("prefix")).otherwise(F.col("prefix") - 1)
    cut = state.alias("c").select("c.source", last.alias("cut"))
    out = ranked.alias("d").join(cut.alias("k"), F.expr("d.source <=> k.source"), "left")
    # no cut where rounding leaves the sum of all just short of the rest: then all are taken
    extra = F.when(F.col("d.key").isNull(), 0).when(F.col("d.key") <= F.coalesce("k.cut", F.lit(2**62)), 1).otherwise(0)
    return out.select(id_col, "d.source", "size", "source_size", "target", (F.col("sure") + extra).cast("int").alias("copies"))


def op6_source_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS documents, (ARRAY[3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sizes GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(2.0 * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM sums WINDOW b AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(level, 2.0 * source_size / w) AS level FROM levels WHERE level * w <= 2.0 * source_size),
goals AS (
  SELECT source, source_size, documents, least(2.0 * source_size, w * coalesce((SELECT level FROM level), 1e300))::DOUBLE AS target,
    CASE WHEN source_size > 0 THEN least(2.0 * source_size, w * coalesce((SELECT level FROM level), 1e300)) / source_size ELSE 0 END AS rate
  FROM sums),
parts AS (SELECT *, floor(rate + 1e-12) AS sure, greatest(0, rate - floor(rate + 1e-12)) AS part FROM goals),
odds AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.sure, g.part, g.part * g.source_size AS rest,
    CASE WHEN g.part > 0 THEN (d.u / (1 - d.u)) / (g.part / (1 - g.part) * sqrt(greatest(d.size, 1) / (g.source_size / g.documents))) END AS q
  FROM sizes d JOIN parts g ON d.source IS NOT DISTINCT FROM g.source),
ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id) AS upto FROM odds)
SELECT doc_id, size, source_size, target,
  (size * (sure + CASE WHEN part <= 0 THEN 0 WHEN upto <= rest THEN 1 WHEN upto - size < rest AND upto - rest <= rest - (upto - size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""
