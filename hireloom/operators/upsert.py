"""Upserting collected postings into the store's tables, and the run's bookkeeping.

The store is five tables; an upsert takes tables and returns tables. Postings are
taken in order, later ones see what earlier ones did.

Almost all postings are plain: those of one canonical URL share no signal with others,
give each external id one URL and each URL one external id, and lead to one stored
posting or all to none. Then the state before a posting is the last value of each field
that was there, a window over its URL's postings in order, and all of them are written
at once, however often one identity comes: a constant number of jobs.

The rest is taken in rounds: a posting is ready when no earlier pending one shares an
identity signal or a stored posting with it, and all ready postings are resolved,
compared and written at once by joins. That needs as many rounds as the longest chain
of such entangled postings.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import checkpointed
from .store import MEANINGFUL, changed_fields, collection_status, kinds_of, resolve_identity, revision_snapshot, run_totals, upsert_outcome

SEEN = ["first_seen_at", "last_seen_at", "last_collected_at"]
REFERENCE = ["id", "job_id", "source_id", "external_id", "source_url", *SEEN]
COUNTERS = ["raw_jobs_found", "created_jobs", "updated_jobs", "unchanged_jobs", "linked_jobs", "invalid_jobs", "persistence_failures"]
OUTCOMES = {"CREATED": "created_jobs", "UPDATED": "updated_jobs", "UNCHANGED": "unchanged_jobs", "LINKED_TO_EXISTING": "linked_jobs", "JOB_IDENTITY_CONFLICT": "persistence_failures"}


@dataclass(frozen=True)
class Store:
    """jobs (id, meaningful fields, times), references, fingerprints, revisions, history."""

    jobs: DataFrame
    references: DataFrame
    fingerprints: DataFrame
    revisions: DataFrame
    history: DataFrame


def _fields(incoming: DataFrame) -> list[str]:
    return [f for f in MEANINGFUL if f in incoming.columns]


def empty_store(incoming: DataFrame) -> Store:
    """A store without rows, of incoming's types."""
    none = incoming.sparkSession.createDataFrame([], incoming.schema)
    time = F.col("collected_at")
    seen = [time.alias(c) for c in SEEN]
    return Store(
        none.select("id", *_fields(incoming), *seen),
        none.select("id", F.col("id").alias("job_id"), "source_id", "external_id", "source_url", *seen),
        none.select("fingerprint", F.col("id").alias("job_id")),
        none.select(F.col("id").alias("job_id"), F.lit(0).alias("revision_number"), time.alias("changed_at"), F.array(F.lit("")).alias("changed_fields"), F.lit("").alias("snapshot"), F.col("id").alias("reference_id")),
        none.select(F.col("id").alias("job_id"), F.lit("").alias("from_status"), F.lit("").alias("to_status"), time.alias("changed_at")),
    )


def _signals(found: DataFrame, *keep: str) -> DataFrame:
    """(keep, signal): what a row's identity is told by, and the stored postings that it leads to."""
    said = lambda name, *cols: F.when(F.concat(*(F.col(c) for c in cols)).isNotNull(), F.to_json(F.struct(F.lit(name).alias("k"), *cols)))
    signals = F.array(said("external", "source_id", "external_id"), said("url", "source_id", "source_url"), said("canonical", "canonical_url"), said("fingerprint", "fingerprint"))
    own = F.concat(F.array_compact(signals), F.transform("job_ids", lambda x: F.concat(F.lit("job "), x.cast("string"))))
    return found.select(*keep, F.explode(own).alias("signal"))


def _ready(found: DataFrame, key: str) -> DataFrame:
    """Keys of the rows that share no signal and no stored posting with an earlier row."""
    shared = _signals(found, key)
    least = shared.groupBy("signal").agg(F.min(key).alias("least"))
    behind = shared.join(least, "signal").where(F.col("least") < F.col(key)).select(key)
    return found.select(key).join(behind, key, "left_anti")


def _plain_urls(found: DataFrame) -> DataFrame:
    """Canonical URLs whose postings touch no others and are one posting, as the module says."""
    url = "canonical_url"
    of = found.where(f"{url} IS NOT NULL")
    hit = F.when(F.size("job_ids") == 1, F.get("job_ids", F.lit(0)))
    whole = F.concat("source_id", "external_id", "source_url").isNotNull()
    least = of.groupBy(url).agg(F.max(F.size("job_ids")).alias("most"), F.min(F.size("job_ids")).alias("least"), F.min(hit).alias("a"), F.max(hit).alias("b"), F.bool_and(whole).alias("whole"))
    plain = least.where("whole AND most <= 1 AND most = least AND (a = b OR most = 0)").select(url)
    # A signal of two URLs, or of one without any, is shared.
    signals = _signals(found, url).groupBy("signal").agg(F.min(url).alias("a"), F.max(url).alias("b"), F.count_if(F.col(url).isNull()).alias("without"))
    shared = _signals(of, url).join(signals.where("a <> b OR without > 0").select("signal"), "signal", "left_semi").select(url)
    two = lambda by, other: of.groupBy(url, "source_id", by).agg(F.min(other).alias("a"), F.max(other).alias("b")).where("a <> b").select(url)
    mixed = shared.unionAll(two("external_id", "source_url")).unionAll(two("source_url", "external_id"))
    return plain.join(mixed, url, "left_anti")


def _apply_plain(batch: DataFrame, store: Store, fields: list[str], key: str) -> tuple[DataFrame, Store]:
    """All postings of plain URLs at once."""
    kinds = kinds_of(batch)
    url = Window.partitionBy("canonical_url").orderBy(key)
    before = url.rowsBetween(Window.unboundedPreceding, -1)
    last = store.revisions.groupBy("job_id").agg(F.max("revision_number").alias("last_revision"))
    both = batch.alias("new").join(store.jobs.alias("old"), F.expr("new.job_id = old.id"), "left").join(last.alias("r"), F.expr("new.job_id = r.job_id"), "left")
    both = both.select(F.struct("new.*").alias("new"), F.struct(*(F.col(f"old.{f}") for f in fields)).alias("was"), "r.last_revision", f"new.{key}", "new.canonical_url", "new.source_id", "new.external_id")
    state = F.struct(*(F.coalesce(F.last(F.col(f"new.{f}"), ignorenulls=True).over(before), F.col(f"was.{f}")).alias(f) for f in fields))
    rows = both.select("new", "last_revision", state.alias("old"), F.row_number().over(url).alias("n"), F.row_number().over(Window.partitionBy("canonical_url", "source_id", "external_id").orderBy(key)).alias("n_reference"), F.first("new.id").over(url).alias("first_id"))
    created = (F.col("n") == 1) & F.col("new.job_id").isNull()
    changed = F.when(~created, changed_fields(fields, kinds=kinds)).otherwise(F.array().cast("array<string>"))
    fresh = F.col("new.reference_id").isNull() & (F.col("n_reference") == 1)
    outcome = upsert_outcome(F.when(created, "CREATED"), changed, fresh)
    rows = rows.withColumns({"changed_fields": changed, "fresh": fresh}).withColumn("outcome", outcome)
    number = F.coalesce("last_revision", F.lit(0)) + F.count_if(F.col("outcome") == "UPDATED").over(Window.partitionBy("new.canonical_url").orderBy(f"new.{key}"))
    rows = rows.withColumn("revision_number", F.when(F.col("outcome") == "UPDATED", number.cast("int")))
    snapshot = F.when(F.col("outcome") == "UPDATED", revision_snapshot(fields, kinds=kinds))
    made = rows.select("new.*", F.coalesce("new.job_id", "first_id").alias("_job"), "changed_fields", "fresh", "outcome", "revision_number", snapshot.alias("snapshot"))
    made = checkpointed(made.drop("job_id").withColumnRenamed("_job", "job_id"))

    time = F.col("collected_at")
    ends = made.groupBy("job_id").agg(F.min_by("collected_at", key).alias("first_seen_at"), F.max(time).alias("seen"), F.bool_or(F.col("outcome") == "CREATED").alias("created"), *(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(key))).alias(f) for f in fields))
    later = lambda c: F.greatest(f"s.{c}", "t.seen").alias(c)  # noqa: E731  a time never goes back
    jobs = store.jobs.alias("s").join(ends.where("NOT created").alias("t"), F.expr("s.id = t.job_id"), "left").select("s.id", *(F.coalesce(f"t.{f}", f"s.{f}").alias(f) for f in fields), "s.first_seen_at", later("last_seen_at"), later("last_collected_at"))
    new_jobs = ends.where("created").select(F.col("job_id").alias("id"), *fields, "first_seen_at", F.col("seen").alias("last_seen_at"), F.col("seen").alias("last_collected_at"))
    known = made.where("reference_id IS NOT NULL").groupBy("reference_id").agg(F.max(time).alias("seen"))
    references = store.references.alias("s").join(known.alias("t"), F.expr("s.id = t.reference_id"), "left").select(*(f"s.{c}" for c in REFERENCE[:6]), later("last_seen_at"), later("last_collected_at"))
    met = made.where("reference_id IS NULL").groupBy("source_id", "external_id", "job_id").agg(F.min_by("source_url", key).alias("source_url"), F.min_by("collected_at", key).alias("first_seen_at"), F.max(time).alias("seen"))
    met = met.select(F.concat_ws(":", "source_id", "external_id", "job_id").alias("id"), "job_id", "source_id", "external_id", "source_url", "first_seen_at", F.col("seen").alias("last_seen_at"), F.col("seen").alias("last_collected_at"))
    prints = made.where("fingerprint IS NOT NULL AND NOT known_fingerprint").select("fingerprint", "job_id").distinct()
    revisions = made.where("outcome = 'UPDATED'").select("job_id", "revision_number", time.alias("changed_at"), "changed_fields", "snapshot", "reference_id")
    history = made.where("outcome = 'CREATED'").select("job_id", F.lit(None).cast("string").alias("from_status"), F.lit("NEW").alias("to_status"), time.alias("changed_at"))
    return made, Store(
        checkpointed(jobs.unionByName(new_jobs)), checkpointed(references.unionByName(met)),
        store.fingerprints.unionByName(prints), store.revisions.unionByName(revisions), store.history.unionByName(history),  # parts that are files already
    )


def _apply(batch: DataFrame, store: Store, fields: list[str]) -> tuple[DataFrame, Store]:
    """One round: batch has resolved rows that don't touch each other."""
    last = store.revisions.groupBy("job_id").agg(F.max("revision_number").alias("last_revision"))
    both = batch.alias("new").join(store.jobs.alias("old"), F.expr("new.job_id = old.id"), "left").join(last.alias("r"), F.expr("new.job_id = r.job_id"), "left")
    kinds = kinds_of(batch)
    changed = F.when(F.col("new.identity").isNull(), changed_fields(fields, kinds=kinds)).otherwise(F.array().cast("array<string>"))
    outcome = upsert_outcome(F.col("new.identity"), changed, F.col("new.reference_id").isNull())
    made = both.select("new.*", changed.alias("changed_fields"), outcome.alias("outcome"), revision_snapshot(fields, kinds=kinds).alias("snapshot"), (F.coalesce("r.last_revision", F.lit(0)) + 1).alias("next_revision"))
    made = made.withColumn("job_id", F.when(F.col("outcome") == "CREATED", F.col("id")).otherwise(F.col("job_id")))
    made = checkpointed(made.withColumn("revision_number", F.when(F.col("outcome") == "UPDATED", F.col("next_revision"))).drop("next_revision"))
    created, stored = made.where("outcome = 'CREATED'"), made.where("outcome IN ('UPDATED', 'LINKED_TO_EXISTING', 'UNCHANGED')")

    seen = [F.col("collected_at").alias(c) for c in SEEN]
    later = lambda c: F.greatest(f"s.{c}", "t.collected_at").alias(c)  # noqa: E731  a time never goes back
    value = lambda f: F.when((F.col("t.outcome") == "UPDATED") & F.col(f"t.{f}").isNotNull(), F.col(f"t.{f}")).otherwise(F.col(f"s.{f}")).alias(f)
    jobs = store.jobs.alias("s").join(stored.alias("t"), F.expr("s.id = t.job_id"), "left").select("s.id", *map(value, fields), "s.first_seen_at", later("last_seen_at"), later("last_collected_at"))
    references = store.references.alias("s").join(stored.where("reference_id IS NOT NULL").alias("t"), F.expr("s.id = t.reference_id"), "left")
    references = references.select(*(f"s.{c}" for c in REFERENCE[:6]), later("last_seen_at"), later("last_collected_at"))
    fresh = created.unionByName(stored.where("reference_id IS NULL")).select(F.concat_ws(":", "source_id", "external_id", "job_id").alias("id"), "job_id", "source_id", "external_id", "source_url", *seen)
    prints = made.where("job_id IS NOT NULL AND fingerprint IS NOT NULL AND NOT known_fingerprint").select("fingerprint", "job_id")
    revisions = stored.where("outcome = 'UPDATED'").select("job_id", "revision_number", F.col("collected_at").alias("changed_at"), "changed_fields", "snapshot", "reference_id")
    history = created.select("job_id", F.lit(None).cast("string").alias("from_status"), F.lit("NEW").alias("to_status"), F.col("collected_at").alias("changed_at"))
    return made, Store(
        checkpointed(jobs.unionByName(created.select("id", *fields, *seen))), checkpointed(references.unionByName(fresh)),
        store.fingerprints.unionByName(prints), store.revisions.unionByName(revisions), store.history.unionByName(history),  # parts that are files already
    )


def upsert(incoming: DataFrame, store: Store, key: str = "position") -> tuple[DataFrame, Store]:
    """(key, source_id, job_id, outcome, revision_number) of each posting, and the store after.

    incoming has a unique, ordered key, id (of the posting if it is new), source_id,
    external_id, source_url, canonical_url, fingerprint, collected_at and those of the
    meaningful fields that a source can hand in. A posting whose signals lead to
    different stored ones is a JOB_IDENTITY_CONFLICT and writes nothing.
    """
    fields, pending, parts = _fields(incoming), checkpointed(incoming), []
    out = [key, "source_id", "job_id", "outcome", "revision_number"]
    found = resolve_identity(pending, store.jobs, store.references, store.fingerprints, key)
    found = checkpointed(found.withColumn("job_id", F.when(F.size("job_ids") == 1, F.get("job_ids", F.lit(0)))))
    plain = checkpointed(_plain_urls(found))
    if not plain.isEmpty():
        made, store = _apply_plain(found.join(plain, "canonical_url", "left_semi"), store, fields, key)
        parts.append(made.select(*out))
        pending = checkpointed(pending.join(plain, "canonical_url", "left_anti").select(incoming.columns))
    while not pending.isEmpty():
        found = resolve_identity(pending, store.jobs, store.references, store.fingerprints, key)
        found = checkpointed(found.withColumn("job_id", F.when(F.size("job_ids") == 1, F.get("job_ids", F.lit(0)))))
        ready = _ready(found, key)
        made, store = _apply(found.join(ready, key, "left_semi"), store, fields)
        parts.append(made.select(*out))
        pending = checkpointed(found.join(ready, key, "left_anti").select(incoming.columns))
    none = incoming.limit(0).select(key, "source_id", F.col("id").alias("job_id"), F.lit("").alias("outcome"), F.lit(0).alias("revision_number"))
    return reduce(DataFrame.unionByName, parts, none), store


def upsert_sources(sources: DataFrame, stored: DataFrame) -> DataFrame:
    """Configured sources over the stored ones, by config_source_id; others stay as they are."""
    rest = stored.join(sources.select("config_source_id"), "config_source_id", "left_anti")
    return sources.unionByName(rest)


# -- the run


def source_results(counts: DataFrame, outcomes: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """A row a source: counters, status, failure_code and failure_message.

    counts has source_id, raw_job_count and invalid_job_count; failures (source_id,
    code, message) has the sources that could not be read, whose counters are 0.
    """
    said = outcomes.groupBy("source_id").agg(*(F.count_if(F.col("outcome") == k).alias(v) for k, v in OUTCOMES.items()))
    rows = counts.select("source_id", F.col("raw_job_count").alias("raw_jobs_found"), F.col("invalid_job_count").alias("invalid_jobs")).join(said, "source_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in COUNTERS})
    bad = F.col("persistence_failures") > 0
    rows = rows.select("source_id", F.when(bad, "PARTIALLY_FAILED").otherwise("SUCCEEDED").alias("status"), *COUNTERS, F.when(bad, "JOB_PERSISTENCE_FAILED").alias("failure_code"), F.when(bad, F.concat(F.col("persistence_failures").cast("string"), F.lit(" job persistence operation(s) failed."))).alias("failure_message"))
    if failures is None:
        return rows
    failed = failures.select("source_id", F.when(F.col("code") == "COLLECTION_ABORTED", "CANCELLED").otherwise("FAILED").alias("status"), *(F.lit(0).cast("long").alias(c) for c in COUNTERS), F.col("code").alias("failure_code"), F.col("message").alias("failure_message"))
    return rows.join(failures.select("source_id"), "source_id", "left_anti").unionByName(failed)


def stored_status(status: Column) -> Column:
    return F.when(status == "SUCCEEDED", "COMPLETED").when(status == "CANCELLED", "SKIPPED").otherwise(status)


def stored_results(results: DataFrame, run_id: str) -> DataFrame:
    """Source results as they are kept, keyed by run and source."""
    return results.select(
        F.lit(run_id).alias("run_id"), "source_id", stored_status(F.col("status")).alias("status"), F.col("raw_jobs_found").alias("discovered_count"), F.col("created_jobs").alias("inserted_count"),
        F.col("updated_jobs").alias("updated_count"), (F.col("unchanged_jobs") + F.col("linked_jobs")).alias("duplicate_count"), F.col("invalid_jobs").alias("invalid_count"),
        (F.col("invalid_jobs") + F.col("persistence_failures")).alias("failed_count"), F.col("failure_code").alias("error_code"), F.col("failure_message").alias("error_message"),
    )


def upsert_results(stored: DataFrame, results: DataFrame) -> DataFrame:
    """Results over the stored ones of the same run and source."""
    return results.unionByName(stored.join(results.select("run_id", "source_id"), ["run_id", "source_id"], "left_anti"))


def run_summary(results: DataFrame, run_id: str, started_at: str, completed_at: str, cancelled: bool = False, initiated_by: str = "cli") -> DataFrame:
    """One row: the run's status, counts of sources, totals, derived counts and errors."""
    named = results.withColumn("run_id", F.lit(run_id))
    totals = run_totals(named, COUNTERS, ["run_id"])
    error = F.when(F.col("failure_code").isNotNull(), F.struct(F.col("source_id").alias("sourceId"), F.col("failure_code").alias("code"), F.coalesce("failure_message", F.lit("Source collection failed.")).alias("message")))
    said = named.groupBy("run_id").agg(
        collection_status(F.col("status"), F.lit(cancelled)).alias("status"), F.count("*").alias("attempted_source_count"), F.count_if(F.col("status").isin("SUCCEEDED", "PARTIALLY_FAILED")).alias("succeeded_source_count"),
        F.count_if(F.col("status") == "FAILED").alias("failed_source_count"), F.to_json(F.array_sort(F.collect_list(error))).alias("error_summary"),  # a row a failed source
    )
    none = F.lit("CANCELLED" if cancelled else "FAILED")  # a run without sources has failed
    one = results.sparkSession.createDataFrame([(run_id, started_at, completed_at, initiated_by)], "run_id string, started_at string, completed_at string, initiated_by string")
    out = one.join(said, "run_id", "left").join(totals, "run_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in [*COUNTERS, "attempted_source_count", "succeeded_source_count", "failed_source_count"]})
    out = out.withColumns({"status": F.coalesce("status", none), "error_summary": F.coalesce("error_summary", F.lit("[]"))})
    return out.withColumns({"duplicate_count": F.col("unchanged_jobs") + F.col("linked_jobs"), "failed_count": F.col("invalid_jobs") + F.col("persistence_failures")})


def collect(postings: DataFrame, store: Store, counts: DataFrame, run_id: str, started_at: str, completed_at: str, failures: DataFrame | None = None, key: str = "position") -> tuple[DataFrame, DataFrame, Store]:
    """(summary, source results, store) of a collection: good postings are upserted in order."""
    outcomes, store = upsert(postings, store, key)
    results = checkpointed(source_results(counts, outcomes, failures))
    return run_summary(results, run_id, started_at, completed_at), results, store


# -- scores


def save_scores(scores: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) scores: the posting must be stored; components sorted by key."""
    known = jobs.select(F.col("id").alias("job_id"))
    order = F.array_sort("components", lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return scores.join(known, "job_id", "left_semi").withColumn("components", order), scores.join(known, "job_id", "left_anti")


def save_recommendations(recommendations: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) recommendations: the score must be of the recommended posting."""
    own = scores.select(F.col("id").alias("score_id"), "job_id")
    return recommendations.join(own, ["score_id", "job_id"], "left_semi"), recommendations.join(own, ["score_id", "job_id"], "left_anti")


def recommendation_batch(recommendations: DataFrame, batch: str) -> DataFrame:
    return recommendations.where(F.col("recommendation_batch") == batch).orderBy("rank", "created_at")


