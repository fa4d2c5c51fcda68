"""A collection from end to end: sources of any type to postings, postings into the store, the run's row.

Boards come as bodies, sites as pages; a source that cannot be read fails alone. The
store is a folder of versions, a folder a run: a run reads the version of the last run
that ended well and writes its own, so a run that fails or dies leaves nothing behind
that is ever read. One writer a store is assumed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import checkpointed
from ..sources.boards import REGISTRY, invalid_envelopes
from ..sources.crawl import page_postings
from . import runs, upsert
from .collect import normalize_candidates, source_counts

#: The types of sources that are sites, and where a board's list is.
SITES = ("generic-page", "generic-job-list")
LIST_PATH = {"greenhouse": "$.jobs", "lever": "$"}
_TABLES = [f.name for f in fields(upsert.Store)]


@dataclass
class Collected:
    """postings that can be stored, in order; counts by source; failures (source_id, code, message) of whole sources."""

    postings: DataFrame
    counts: DataFrame
    failures: DataFrame


def gather(sources: DataFrame, bodies: DataFrame, pages: DataFrame, collected_at: str) -> Collected:
    """sources: source_id, type, company, url and, where it has them, enabled and a site's settings
    (crawl.py); bodies: source_id, body; pages: url, html, rendered. A type without a
    loader, a board without a body and a body that is no list are failures of their source."""
    active = sources.where("coalesce(enabled, true)") if "enabled" in sources.columns else sources
    active = checkpointed(active.dropDuplicates(["source_id"]))
    parts, failures = [], []
    fail = lambda rows, code, message: failures.append(rows.select("source_id", F.lit(code).alias("code"), F.lit(message).alias("message")))
    for kind, load in REGISTRY.items():
        own = active.where(F.col("type") == kind).select("source_id", "company")
        held = bodies.join(own, "source_id")
        fail(own.join(bodies.select("source_id"), "source_id", "left_anti"), "SOURCE_UNAVAILABLE", "The source returned no response.")
        broken = invalid_envelopes(held, LIST_PATH[kind]).distinct()
        fail(broken, "SOURCE_RESPONSE_INVALID", "The source's response is not a list of jobs.")
        items = load(held.join(broken, "source_id", "left_anti"))
        parts.append(normalize_candidates(items.withColumn("order", F.lpad(F.to_json(F.struct("pos")), 40, " ")), F.lit(kind), collected_at))
    sites = active.where(F.col("type").isin(*SITES))
    if not sites.isEmpty():
        roots = sites.withColumn("is_list", F.col("type") == "generic-job-list")
        good, crawled = page_postings(pages, roots, F.col("type"), collected_at)
        parts.append(good)
        failures.append(crawled.errors.select("source_id", "code", "message"))
    unknown = active.where(~F.coalesce(F.col("type").isin(*REGISTRY, *SITES), F.lit(False)))
    fail(unknown, "COLLECTOR_NOT_FOUND", "No collector is registered for the source's type.")
    every = checkpointed(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))
    failed = checkpointed(reduce(DataFrame.unionAll, failures))
    counted = source_counts(every)
    quiet = active.select("source_id").join(failed.select("source_id"), "source_id", "left_anti").join(counted.select("source_id"), "source_id", "left_anti")
    zero = F.lit(0).cast("long")
    counts = counted.unionAll(quiet.select("source_id", *(zero.alias(c) for c in counted.columns[1:])))
    return Collected(every.where("rejected IS NULL").withColumn("position", F.struct("source_id", "order", "external_id")), checkpointed(counts), failed)


def _folder(path: str, run_id: str) -> str:
    return f"{path}/versions/{run_id}"


def load_store(spark: SparkSession, path: str, like: DataFrame) -> upsert.Store:
    """The version of the last run that ended well; an empty store of like's types if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/runs")
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        done = runs.runs(spark, f"{path}/runs").where(F.col("status").isin(runs.COMPLETED, runs.PARTIALLY_FAILED)).orderBy(F.desc("completed_at"), F.desc("run_id")).first()
        if done:
            empty = upsert.empty_store(like)
            return upsert.Store(*(spark.read.schema(getattr(empty, t).schema).parquet(f"{_folder(path, done['run_id'])}/{t}") for t in _TABLES))
    return upsert.empty_store(like)


def collect(spark: SparkSession, path: str, sources: DataFrame, bodies: DataFrame, pages: DataFrame, initiated_by: str = "cli", clock: Callable[[], str] = runs.now) -> dict[str, object]:
    """A run over the store at path; its summary: status, counters, errors as JSON."""

    def work(run: runs.Run) -> dict[str, int]:
        at = clock()
        got = gather(sources, bodies, pages, at)
        row, results, store = upsert.collect(got.postings, load_store(spark, path, got.postings), got.counts, run.run_id, at, at, got.failures)
        for t in _TABLES:
            getattr(store, t).write.parquet(f"{_folder(path, run.run_id)}/{t}")
        upsert.stored_results(results, run.run_id).write.parquet(f"{_folder(path, run.run_id)}/results")
        said = row.drop("run_id", "started_at", "completed_at", "initiated_by").first().asDict()
        return said | {"considered_count": said["attempted_source_count"], "error_count": said["attempted_source_count"] if said["status"] == "FAILED" else said["failed_source_count"] or int(said["status"] == "PARTIALLY_FAILED")}

    return runs.execute(spark, f"{path}/runs", work, initiated_by, clock=clock)
