"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


#: Edges up to which a round runs in few tasks, and edges a task.
SMALL, PER_TASK = 1_000_000, 50_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; component is the smallest node reachable.

    Large-star links each node's larger neighbours to the least of its
    neighbourhood, small-star its smaller ones, until nothing changes (Kiveris et
    al., SoCC 2014): a number of rounds like the logarithm of the longest path.
    Minima are combined before the shuffle, and a hub's edges meet its minimum in
    a join of two tables, which Spark can split: no neighbourhood is ever one
    row or one group. Loops, repeated edges and edges with a null are ignored.
    """
    now = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    now = saved(now.where("a < b").distinct(), "edges")
    mark = _mark(now)
    # Few edges go to few tasks; many are joined from files, so that Spark can split a hub's.
    small = mark[0] <= SMALL
    kept = lambda df, name: saved(df.coalesce(max(1, mark[0] // PER_TASK)) if small else df, name)
    while mark[0]:
        old = now
        both = old.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(old.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = least if small else saved(least, "least")
        large = kept(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "large")
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        lower = lower if small else saved(lower, "lower")
        met = large.join(lower, "b")
        star = met.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        now = kept(star.where("a < b").distinct(), "edges")
        new = _mark(now)
        for x in (least, large, lower, old):
            forget(x)
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(roots)
