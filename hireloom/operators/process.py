"""Processing: stored postings to versioned decisions, incremental and idempotent."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import checkpointed
from . import vocabulary as V
from .dedup import classify, with_fingerprint
from .filters import Candidate, hard_filters
from .mapping import CODE, broken_rule
from .normalize import HardFilterConfig, normalize
from .store import latest

DECISION_KEY = ["job_id", "input_revision_number", "normalization_version", "fingerprint_version", "filter_rules_version", "config_fingerprint"]
#: Fixed value: what a decision says of a posting's own error; the field is beside it.
ERROR_MESSAGE = "Job processing failed. See structured diagnostics."
#: Fixed order of the configuration's keys in its fingerprint (a locale's order, not code points').
_CONFIG_KEYS = {
    "allowedCountries": "allowed_countries", "allowedCountryGroups": "allowed_country_groups", "allowMandatoryPhd": "allow_mandatory_phd", "companyLegalSuffixes": "company_legal_suffixes",
    "excludedCompanies": "excluded_companies", "excludedIndustries": "excluded_industries", "excludedTitlePhrases": "excluded_title_phrases", "maximumRequiredExperienceYears": "maximum_required_experience_years",
    "maximumSeniority": "maximum_seniority", "rejectUnknownIndustry": "reject_unknown_industry", "rejectUnknownLocation": "reject_unknown_location",
    "removableTrackingParameters": "removable_tracking_parameters", "unknownCandidateLanguageLevelPolicy": "unknown_candidate_language_level_policy",
}


def config_fingerprint(candidate: Candidate, config: HardFilterConfig) -> str:
    """SHA-256 of the settings that decide, lists sorted, so their order is no change."""
    values = asdict(config)
    plain = lambda v: sorted(v) if isinstance(v, list) else int(v) if isinstance(v, float) and v.is_integer() else v
    said = {
        "candidate": {
            "citizenships": sorted(candidate.citizenships), "educationLevels": sorted(candidate.education_levels),
            "languages": [{"code": k, "proficiency": v} for k, v in sorted(candidate.languages.items())],
            "workAuthorizations": [{"country": c, "status": s} for c, s in sorted(candidate.work_authorizations)],
        },
        "hardFilters": {k: plain(values[v]) for k, v in _CONFIG_KEYS.items()},
    }
    text = json.dumps(said, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(unicodedata.normalize("NFKC", text).encode()).hexdigest()


def check_limit(limit: int) -> int:
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= 10_000:
        raise ValueError("Processing limit must be an integer from 1 through 10000.")
    return limit


def first_references(references: DataFrame) -> DataFrame:
    """(job_id, ref): each posting's first source reference, by first_seen_at and id."""
    return references.groupBy("job_id").agg(F.min_by(F.struct("source_id", "external_id", "source_url"), F.struct("first_seen_at", "id")).alias("ref"))


def processable(jobs: DataFrame, references: DataFrame, revisions: DataFrame, limit: int) -> DataFrame:
    """The batch: earliest collected first, with each job's first source reference and latest revision."""
    batch = jobs.orderBy("last_collected_at", "id").limit(check_limit(limit))
    first = first_references(references)
    latest = revisions.groupBy("job_id").agg(F.max("revision_number").alias("revision"))
    out = batch.join(first, batch["id"] == first["job_id"], "left").drop("job_id").join(latest, batch["id"] == latest["job_id"], "left").drop("job_id")
    return out.withColumns({"source_id": F.col("ref.source_id"), "external_id": F.col("ref.external_id"), "source_url": F.coalesce("ref.source_url", "canonical_url"), "input_revision_number": F.coalesce("revision", F.lit(0))}).drop("ref", "revision")


def status(decision: Column, filtered: Column) -> Column:
    return F.when(decision == "DUPLICATE", "DUPLICATE").when(filtered == "REJECTED", "REJECTED").when(decision == "POSSIBLE_DUPLICATE", "POSSIBLE_DUPLICATE").otherwise("ELIGIBLE")


def decide(jobs: DataFrame, candidate: Candidate, config: HardFilterConfig, processing_time: str) -> DataFrame:
    """A decision for every posting of the batch. One that cannot be read is an ERROR of its
    own, with a code and a safe message; it takes no part in the others' decisions."""
    told = jobs.withColumn("_broken", broken_rule(jobs))
    wrong = told.where("_broken IS NOT NULL")
    # Read by every stage of classifying and by the filters, and by far the dearest part: made once.
    normalized = checkpointed(with_fingerprint(normalize(told.where("_broken IS NULL").drop("_broken"), config)))
    good = hard_filters(classify(normalized.where("valid")), candidate, config, processing_time)
    # confirmed duplicates are not filtered
    dup = F.col("duplicate_decision") == "DUPLICATE"
    good = good.withColumn("reasons", F.when(~dup, F.col("reasons"))).withColumn("filter_decision", F.when(~dup, F.col("filter_decision")))
    good = good.withColumn("processing_status", status(F.col("duplicate_decision"), F.col("filter_decision")))
    bad = normalized.where("NOT valid").withColumn("processing_status", F.lit("NORMALIZATION_FAILED"))
    error = {"processing_status": F.lit("ERROR"), "error_code": F.lit(CODE), "error_field": F.col("_broken.field"), "error_message": F.lit(ERROR_MESSAGE)}
    failed = wrong.withColumns(error).select("id", "input_revision_number", *error)
    out = good.unionByName(bad, allowMissingColumns=True).unionByName(failed, allowMissingColumns=True)
    versions = {"normalization_version": V.NORMALIZATION_VERSION, "fingerprint_version": V.FINGERPRINT_VERSION, "filter_rules_version": V.FILTER_VERSION, "config_fingerprint": config_fingerprint(candidate, config), "processed_at": processing_time}
    return out.withColumnRenamed("id", "job_id").withColumns({k: F.lit(v) for k, v in versions.items()})


def pending(jobs: DataFrame, decisions: DataFrame, fingerprint: str) -> DataFrame:
    """Postings of which no decision with these versions exists."""
    made = decisions.where((F.col("normalization_version") == V.NORMALIZATION_VERSION) & (F.col("fingerprint_version") == V.FINGERPRINT_VERSION) & (F.col("filter_rules_version") == V.FILTER_VERSION) & (F.col("config_fingerprint") == fingerprint))
    made = made.select(F.col("job_id").alias("id"), "input_revision_number").distinct()
    return jobs.join(made, ["id", "input_revision_number"], "left_anti")


def process(jobs: DataFrame, decisions: DataFrame, candidate: Candidate, config: HardFilterConfig, processing_time: str) -> DataFrame:
    """New decisions only. If any posting is pending, all are classified, as candidates for
    duplicates, and those that are decided are left out of the result."""
    todo = pending(jobs, decisions, config_fingerprint(candidate, config))
    if todo.isEmpty():  # nothing is normalized or classified then
        return decide(jobs.limit(0), candidate, config, processing_time)
    made = decide(jobs, candidate, config, processing_time)
    keys = todo.select(F.col("id").alias("job_id"), "input_revision_number")
    return made.join(keys, ["job_id", "input_revision_number"], "left_semi")


def derived(made: DataFrame) -> DataFrame:
    """What a decision derives of a posting, a row a normalized one (UPS19)."""
    required = F.get(F.filter("education_requirements", lambda r: r["requirement"] == "REQUIRED"), F.lit(0))
    return made.where("valid").select(
        "job_id", "processed_at", "normalized_title", "normalized_company", F.col("location_key").alias("normalized_location_key"), F.col("identity_url").alias("canonical_application_url"), "normalization_version",
        F.col("issues").alias("normalization_issues"), "seniority", F.when(F.size("experience_requirements") > 0, F.col("experience_requirements")).alias("required_experience"), required["level"].alias("required_education"),
        F.col("language_requirements").alias("required_languages"), F.col("skill_requirements").alias("skills"), F.transform("skill_requirements", lambda x: x["canonical_name"]).alias("normalized_skills"),
    )


def current(derived_rows: DataFrame) -> DataFrame:
    """Each posting's latest derived columns (PRC15), kept apart from the collected ones, so
    that collecting an unchanged posting again makes no revision."""
    return latest(derived_rows, ["job_id"], [F.desc("processed_at")])


def summary(considered: DataFrame, made: DataFrame, cancelled: bool = False) -> DataFrame:
    """One row of counters and the run's status; normalization failures are no errors."""
    names = {"normalization_failed_count": "NORMALIZATION_FAILED", "duplicate_count": "DUPLICATE", "possible_duplicate_count": "POSSIBLE_DUPLICATE", "rejected_count": "REJECTED", "eligible_count": "ELIGIBLE", "error_count": "ERROR"}
    n = made.agg(F.count("*").alias("made"), *(F.count_if(F.col("processing_status") == v).alias(k) for k, v in names.items()))
    out = considered.agg(F.count("*").alias("considered_count")).crossJoin(n)  # one row by one row
    out = out.withColumn("normalized_count", F.col("made") - F.col("normalization_failed_count") - F.col("error_count")).withColumn("skipped_count", F.col("considered_count") - F.col("made")).drop("made")
    return out.withColumn("status", run_status(F.lit(cancelled), F.col("error_count"), F.col("considered_count")))


def run_status(cancelled: Column, errors: Column, considered: Column) -> Column:
    return F.when(cancelled, "CANCELLED").when(errors == 0, "COMPLETED").when(errors < considered, "PARTIALLY_FAILED").otherwise("FAILED")
