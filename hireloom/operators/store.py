"""Store operators on tables: identity resolution, change detection, history, runs, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fields whose change makes a revision, in order.
MEANINGFUL = [
    "title", "company", "description", "canonical_url", "application_url", "normalized_title", "normalized_company", "locations", "remote_policy", "employment_type", "seniority",
    "salary_minimum", "salary_maximum", "salary_currency", "salary_period", "required_experience", "required_education", "required_languages", "skills", "normalized_skills",
    "published_at", "expires_at", "metadata",
]


def identity_fingerprint(company: Column, title: Column, url: Column) -> Column:
    """SHA-256 of company, title and URL, each cleaned and in lower case, a line each."""
    from ..functions.text import clean

    return F.sha2(F.concat_ws("\n", *(F.lower(clean(c)) for c in (company, title, url))), 256)


#: The fields that hold lists or objects, compared as JSON.
JSON_FIELDS = ["locations", "required_experience", "required_languages", "skills", "normalized_skills", "metadata"]


def canonical_json(value: Column) -> Column:
    """JSON text with its keys sorted at every level and numbers in one spelling; text that
    is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(value)), value)


def _plain(field: str, value: Column, kinds: dict[str, T.DataType]) -> Column:
    """What is compared of a field: lists, maps and objects by value, whatever the order of their keys."""
    kind = kinds.get(field, T.StringType() if field in JSON_FIELDS else None)
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return canonical_json(F.to_json(value))
    return canonical_json(value) if field in JSON_FIELDS and isinstance(kind, T.StringType) else value


def kinds_of(rows: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in rows.schema}


def changed_fields(fields: list[str], old: str = "old", new: str = "new", kinds: dict[str, T.DataType] | None = None) -> Column:
    """Names of fields whose incoming value is there and differs; absence never clears."""
    pair = lambda f: (_plain(f, F.col(f"{side}.{f}"), kinds or {}) for side in (old, new))
    return F.array_compact(F.array(*(F.when(F.col(f"{new}.{f}").isNotNull() & (lambda a, b: ~a.eqNullSafe(b))(*pair(f)), F.lit(f)) for f in fields)))


def revision_snapshot(fields: list[str], old: str = "old", new: str = "new", kinds: dict[str, T.DataType] | None = None) -> Column:
    """JSON of {field: {before, after}} of the changed fields; lists and objects as JSON values."""
    kinds = kinds or {}

    def value(f: str, side: str) -> Column:
        at = F.col(f"{side}.{f}")
        if isinstance(kinds.get(f), T.ArrayType | T.MapType | T.StructType):
            return F.parse_json(F.to_json(at))
        if f in JSON_FIELDS and isinstance(kinds.get(f, T.StringType()), T.StringType):
            return F.coalesce(F.try_parse_json(at), at.cast("variant"))
        return at.cast("string").cast("variant")

    changed = changed_fields(fields, old, new, kinds)
    both = F.create_map(*[x for f in fields for x in (F.lit(f), F.struct(value(f, old).alias("before"), value(f, new).alias("after")))])
    return F.to_json(F.map_filter(both, lambda k, _: F.array_contains(changed, k)), {"ignoreNullFields": "false"})


def resolve_identity(incoming: DataFrame, jobs: DataFrame, references: DataFrame, fingerprints: DataFrame, key: str) -> DataFrame:
    """incoming plus job_ids, the set of stored postings that external id, source URL, canonical
    URL and fingerprint lead to, reference_id, the reference found by external id or else by
    URL, known_fingerprint, and identity: CREATED, JOB_IDENTITY_CONFLICT or null (one found)."""
    refs = references.select("source_id", "external_id", "source_url", "job_id", F.col("id").alias("ref"))
    none = F.lit(None).cast(references.schema["id"].dataType)
    hits = [
        incoming.join(refs.drop("source_url"), ["source_id", "external_id"]).select(key, "job_id", F.col("ref").alias("by_external"), none.alias("by_url"), F.lit(False).alias("by_print")),
        incoming.join(refs.drop("external_id"), ["source_id", "source_url"]).select(key, "job_id", none.alias("by_external"), F.col("ref").alias("by_url"), F.lit(False).alias("by_print")),
        incoming.join(jobs.select("canonical_url", F.col("id").alias("job_id")), "canonical_url").select(key, "job_id", none.alias("by_external"), none.alias("by_url"), F.lit(False).alias("by_print")),
        incoming.join(fingerprints.select("fingerprint", "job_id"), "fingerprint").select(key, "job_id", none.alias("by_external"), none.alias("by_url"), F.lit(True).alias("by_print")),
    ]
    found = hits[0].unionAll(hits[1]).unionAll(hits[2]).unionAll(hits[3])
    sets = found.groupBy(key).agg(F.sort_array(F.collect_set("job_id")).alias("job_ids"), F.min("by_external").alias("by_external"), F.min("by_url").alias("by_url"), F.bool_or("by_print").alias("known_fingerprint"))
    out = incoming.join(sets, key, "left").withColumn("job_ids", F.coalesce("job_ids", F.array().cast(sets.schema["job_ids"].dataType))).withColumn("reference_id", F.coalesce("by_external", "by_url")).withColumn("known_fingerprint", F.coalesce("known_fingerprint", F.lit(False)))
    return out.drop("by_external", "by_url").withColumn("identity", F.when(F.size("job_ids") == 0, "CREATED").when(F.size("job_ids") > 1, "JOB_IDENTITY_CONFLICT"))


def upsert_outcome(identity: Column, changed: Column, linked: Column) -> Column:
    return F.when(identity.isNotNull(), identity).when(F.size(changed) > 0, "UPDATED").when(linked, "LINKED_TO_EXISTING").otherwise("UNCHANGED")


def status_changes(updates: DataFrame, key: str, order: list[str], status: str, initial: Column) -> DataFrame:
    """Rows whose status differs from the one before it of the same key, with from_status."""
    before = F.coalesce(F.lag(status).over(Window.partitionBy(key).orderBy(*order)), initial)
    return updates.withColumn("from_status", before).where(F.col("from_status") != F.col(status))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def run_totals(results: DataFrame, counters: list[str], by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(*(F.sum(c).cast("long").alias(c) for c in counters))


def collection_status(status: Column, cancelled: Column) -> Column:
    """Of a run, over its sources' statuses, as an aggregate."""
    return F.when(F.bool_or(cancelled), "CANCELLED").when(F.bool_and(status == "FAILED"), "FAILED").when(F.bool_or(status.isin("FAILED", "PARTIALLY_FAILED")), "PARTIALLY_FAILED").otherwise("COMPLETED")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key refers to nothing."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")
