"""Collection: candidates of any source to stored postings, good and rejected apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, html_to_text, presence
from ..functions.urls import normalize_url
from . import vocabulary as V
from .store import identity_fingerprint

#: What a source hands in: struct fields of a candidate, all optional but the first three.
CANDIDATE = ["external_id", "title", "source_url", "company", "application_url", "description", "location_text", "department", "raw_employment_type", "raw_workplace_type", "published_at", "expires_at", "metadata"]


def _mapped(value: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(clean(value)))


def iso_timestamp(value: Column) -> Column:
    """ISO-8601 with milliseconds in UTC; null if it is no time."""
    return F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def first_by_external_id(items: DataFrame, order: str) -> DataFrame:
    """The first item of each source's external id; later ones have repeated = true."""
    w = Window.partitionBy("source_id", "external_id").orderBy(order)
    return items.withColumn("repeated", F.row_number().over(w) > 1)


def normalize_candidates(items: DataFrame, source_type: Column, collected_at: str) -> DataFrame:
    """items (source_id and the fields of CANDIDATE) to postings with a column rejected:
    why one cannot be stored, or null. Items marked invalid or repeated are rejected too; a
    column order is kept."""
    url = normalize_url(F.col("source_url"))
    apply_url = normalize_url(F.col("application_url"))
    a = items.withColumns({"u": url, "v": F.when(F.col("application_url").isNotNull(), apply_url), "external_id": clean(F.col("external_id")), "title": clean(F.col("title")), "company": clean(F.col("company"))})
    said = lambda code: F.when(code == "HTTPS_REQUIRED", "Job URL must use HTTPS.").when(code == "CREDENTIALS_NOT_ALLOWED", "Job URL must not contain credentials.").when(code.isNotNull(), "Job URL is invalid.")
    required = lambda c, name: F.when(F.coalesce(F.col(c), F.lit("")) == "", f"Job {name} is required.")
    bad_time = lambda c: F.when(F.col(c).isNotNull() & iso_timestamp(F.col(c)).isNull(), "Job timestamp is invalid.")
    marked = [F.when(F.col(c), said) for c, said in (("invalid", "Job shape was invalid."), ("repeated", "Duplicate job was ignored.")) if c in items.columns]
    rejected = F.coalesce(*marked, required("external_id", "external ID"), required("title", "title"), required("company", "company"), said(F.col("u.code")), said(F.col("v.code")), bad_time("published_at"), bad_time("expires_at"))
    known = {"collector": source_type, "locationText": presence(clean(F.col("location_text"))), "department": presence(clean(F.col("department"))), "sourceEmploymentType": clean(F.col("raw_employment_type")), "sourceWorkplaceType": clean(F.col("raw_workplace_type"))}
    own = F.from_json(F.coalesce("metadata", F.lit("{}")), "map<string,string>")
    table = F.map_filter(F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in known.items()))), lambda _, v: v.isNotNull())
    merged = F.map_concat(F.map_filter(table, lambda k, _: ~F.map_contains_key(own, k)), own)
    out = a.select(
        F.concat_ws(":", "source_id", "external_id").alias("id"), "source_id", "external_id", F.col("u.value").alias("source_url"), F.col("u.value").alias("canonical_url"), "title", "company",
        html_to_text(F.col("description")).alias("description"), _mapped(F.col("raw_workplace_type"), V.REMOTE).alias("remote_policy"), _mapped(F.col("raw_employment_type"), V.EMPLOYMENT).alias("employment_type"),
        F.coalesce("v.value", "u.value").alias("application_url"), iso_timestamp(F.col("published_at")).alias("published_at"), iso_timestamp(F.col("expires_at")).alias("expires_at"),
        F.lit(collected_at).alias("collected_at"), F.to_json(merged).alias("metadata"), F.lower("title").alias("normalized_title"), F.lower("company").alias("normalized_company"), rejected.alias("rejected"),
        *(["order"] if "order" in items.columns else []),
    )
    return out.withColumn("fingerprint", identity_fingerprint(F.col("company"), F.col("title"), F.col("canonical_url")))


def source_counts(good: DataFrame) -> DataFrame:
    """Per source: items, those that cannot be stored (invalid, repeated or rejected), those that can."""
    bad = F.col("rejected").isNotNull()
    return good.groupBy("source_id").agg(F.count("*").alias("raw_job_count"), F.count_if(bad).alias("invalid_job_count"), F.count_if(~bad).alias("candidate_count"))
