"""Stored rows to typed ones: what a row must hold is a table of rules, compiled to columns.

A row that breaks a rule is not read: it goes to the rejects with the field's name, the
code DATA_MAPPING_FAILED and a message; the others go on. Rules name fields that a table
may lack; those are passed over. A list or object may be typed or JSON text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODE = "DATA_MAPPING_FAILED"

#: What the enumerations hold.
STATUSES = ("NEW", "RECOMMENDED", "VIEWED", "APPLIED", "SKIPPED", "REJECTED", "ARCHIVED", "EXPIRED")
REMOTE_POLICIES = ("onsite", "hybrid", "remote")
EMPLOYMENT_TYPES = ("full-time", "part-time", "contract", "internship", "temporary")


@dataclass(frozen=True)
class Rule:
    """kind: one_of, finite, time, json, strings (a list of strings), places (a list of objects
    with a country). A null breaks a rule only where the field is needed."""

    field: str
    kind: str
    message: str
    values: tuple[str, ...] = ()
    needed: bool = False


JOB_RULES = (
    Rule("id", "text", "Job must have an id.", needed=True),
    Rule("current_status", "one_of", "Job contains an unknown lifecycle status.", STATUSES, True),
    Rule("remote_policy", "one_of", "Job contains an unknown remote policy.", REMOTE_POLICIES),
    Rule("employment_type", "one_of", "Job contains an unknown employment type.", EMPLOYMENT_TYPES),
    Rule("locations", "list", "Job locations must be an array."),
    Rule("locations", "places", "Job location must contain a country string."),
    Rule("normalized_skills", "strings", "normalizedSkills must contain only strings."),
    Rule("salary_minimum", "finite", "salaryMinimum must be a finite number."),
    Rule("salary_maximum", "finite", "salaryMaximum must be a finite number."),
    Rule("published_at", "time", "publishedAt must be a valid ISO-8601 timestamp."),
    Rule("expires_at", "time", "expiresAt must be a valid ISO-8601 timestamp."),
    Rule("first_seen_at", "time", "firstSeenAt must be a valid ISO-8601 timestamp."),
    Rule("last_collected_at", "time", "lastCollectedAt must be a valid ISO-8601 timestamp."),
    Rule("metadata", "json", "metadata must be JSON."),
)
SCORE_RULES = (Rule("job_id", "text", "Score must have a job.", needed=True), Rule("total", "finite", "Score total must be a finite number.", needed=True), Rule("components", "json", "Score components must be JSON."))


def _holds(rule: Rule, kind: T.DataType) -> Column:
    """Whether a value that is there keeps the rule."""
    value = F.col(rule.field)
    text = isinstance(kind, T.StringType)
    if rule.kind == "one_of":
        return value.isin(*rule.values)
    if rule.kind == "finite":
        number = value.try_cast("double") if text else value.cast("double")
        return number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    if rule.kind == "time":
        return (F.try_to_timestamp(value) if text else value).isNotNull()
    if rule.kind == "json":
        return F.try_parse_json(value).isNotNull() if text else F.lit(True)
    if rule.kind == "text":
        return value.cast("string") != ""
    items = F.try_variant_get(F.try_parse_json(value), "$", "array<variant>") if text else value
    if rule.kind == "list":
        return items.isNotNull()
    if rule.kind == "strings":
        return F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))) if text else F.forall(items, lambda x: x.isNotNull())
    country = (lambda x: F.schema_of_variant(F.try_variant_get(x, "$.country", "variant")) == "STRING") if text else (lambda x: x["country"].isNotNull())
    return F.coalesce(F.forall(items, lambda x: F.coalesce(country(x), F.lit(False))), F.lit(False))


def broken_rule(rows: DataFrame, rules: tuple[Rule, ...] = JOB_RULES) -> Column:
    """struct<field, message> of the first rule that a row breaks, null if it keeps all."""
    broken = []
    for rule in rules:
        if rule.field in rows.columns:
            holds = F.coalesce(_holds(rule, rows.schema[rule.field].dataType), F.lit(False))
            bad = F.col(rule.field).isNull() | ~holds if rule.needed else F.col(rule.field).isNotNull() & ~holds
            broken.append(F.when(bad, F.struct(F.lit(rule.field).alias("field"), F.lit(rule.message).alias("message"))))
    return F.coalesce(*broken) if broken else F.lit(None).cast("struct<field:string,message:string>")


def mapped(rows: DataFrame, rules: tuple[Rule, ...] = JOB_RULES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected rows have code, field and message."""
    told = rows.withColumn("_broken", broken_rule(rows, rules))
    rejected = told.where("_broken IS NOT NULL").withColumns({"code": F.lit(CODE), "field": F.col("_broken.field"), "message": F.col("_broken.message")})
    return told.where("_broken IS NULL").drop("_broken"), rejected.drop("_broken")
