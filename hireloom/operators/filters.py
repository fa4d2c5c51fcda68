"""Hard filters: a posting's reasons for rejection, all of them, in a fixed order.

Every filter is an array of reasons from literals and array functions, so a
rejected posting costs no shuffle and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import company_key_of, comparison_key, held, key_of
from . import vocabulary as V
from .normalize import HardFilterConfig


@dataclass(frozen=True)
class Candidate:
    """What the filters know of the candidate."""

    education_levels: list[str] = field(default_factory=list)
    languages: dict[str, str] = field(default_factory=dict)  # code to proficiency
    citizenships: list[str] = field(default_factory=list)
    work_authorizations: list[tuple[str, str]] = field(default_factory=list)  # country, status


REASON = "struct<code:string,filter_id:string,details:string,evidence:string>"


def reason(code: str, filter_id: str, details: Column | str, **evidence: Column) -> Column:
    said = F.to_json(F.struct(*(v.alias(k) for k, v in evidence.items())), {"ignoreNullFields": "false"}) if evidence else F.lit(None).cast("string")
    return F.struct(F.lit(code).alias("code"), F.lit(filter_id).alias("filter_id"), (details if isinstance(details, Column) else F.lit(details)).alias("details"), said.alias("evidence"))


def _when(condition: Column, row: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(row)).otherwise(F.array().cast(f"array<{REASON}>"))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _order(level: Column, levels: list[str]) -> Column:
    return F.array_position(_strings(levels), level)


def country(c: HardFilterConfig) -> Column:
    if not (c.allowed_countries or c.allowed_country_groups):
        return F.array().cast(f"array<{REASON}>")
    allowed = sorted({*c.allowed_countries, *(x for g in c.allowed_country_groups for x in V.GROUPS[g])})
    fitting = [g for g, members in V.GROUPS.items() if set(members) & set(allowed)]
    codes = F.col("country_codes")
    fine = (F.col("remote_scope") == "WORLDWIDE") | F.col("remote_scope").isin(fitting) | F.arrays_overlap(codes, _strings(allowed))
    unknown = F.size(codes) == 0
    joined = F.array_join(codes, ", ")
    no_place = reason("COUNTRY_NOT_ALLOWED", "country", "Job location is unknown and configuration rejects unknown locations.", country=F.lit(None).cast("string"))
    outside = reason("COUNTRY_NOT_ALLOWED", "country", F.concat(F.lit("Job countries "), joined, F.lit(" are outside the allowed geography.")), country=joined)
    return F.when(F.coalesce(fine, F.lit(False)), _when(F.lit(False), outside)).when(unknown, _when(F.lit(c.reject_unknown_location), no_place)).otherwise(F.array(outside))


def work_authorization(p: Candidate) -> Column:
    own = set(p.citizenships)
    authorized = own | {c for c, status in p.work_authorizations if status != "sponsorship-required"}
    within = lambda who, group: F.when(group == "EU", F.lit(bool(who & set(V.EU)))).otherwise(F.lit(bool(who & set(V.EEA))))

    def fails(r: Column) -> Column:
        code, group = r["country_code"], r["country_group"]
        may = code.isNull() | F.array_contains(_strings(sorted(authorized)), code)
        may_group = group.isNull() | within(authorized, group)
        citizen = ~r["citizenship_only"] | F.when(code.isNotNull(), F.array_contains(_strings(sorted(own)), code)).when(group.isNotNull(), within(own, group)).otherwise(False)
        offered = F.coalesce(r["sponsorship_available"], F.lit(False)) & ~r["citizenship_only"] & ~r["security_clearance_required"]
        return ~(may & may_group & citizen & ~r["security_clearance_required"]) & ~offered

    details = "The job has an explicit authorization, citizenship, or clearance requirement not satisfied by the profile."
    failing = F.filter("work_authorization_requirements", lambda r: F.coalesce(fails(r), F.lit(True)))
    return F.transform(failing, lambda r: reason("WORK_AUTHORIZATION_NOT_AVAILABLE", "work-authorization", details, country=F.coalesce(r["country_code"], r["country_group"]), sponsorshipAvailable=F.coalesce(r["sponsorship_available"], F.lit(False))))


def language(p: Candidate, c: HardFilterConfig) -> Column:
    table = F.create_map(*[F.lit(x) for kv in p.languages.items() for x in kv]) if p.languages else F.create_map().cast("map<string,string>")
    has = lambda r: F.try_element_at(table, r["code"])
    enough = lambda r: F.coalesce(_order(has(r), V.LANGUAGE_LEVELS) >= _order(r["proficiency"], V.LANGUAGE_LEVELS), F.lit(False))
    counts = lambda r: has(r).isNotNull() | F.lit(c.unknown_candidate_language_level_policy == "reject")
    failing = F.filter("language_requirements", lambda r: (r["requirement"] == "REQUIRED") & ~enough(r) & counts(r))
    details = lambda r: F.concat(r["name"], F.lit(" "), r["proficiency"], F.lit(" is mandatory and the candidate does not meet it."))
    return F.transform(failing, lambda r: reason("MISSING_REQUIRED_LANGUAGE", "language", details(r), language=r["name"], requiredLevel=r["proficiency"], candidateLevel=has(r)))


def seniority(c: HardFilterConfig) -> Column:
    over = _order(F.col("seniority"), V.SENIORITY) > V.SENIORITY.index(c.maximum_seniority) + 1
    details = F.concat(F.lit("Detected seniority "), F.col("seniority"), F.lit(f" exceeds maximum {c.maximum_seniority}."))
    return _when(over, reason("SENIORITY_EXCEEDS_MAXIMUM", "seniority", details, detected=F.col("seniority"), maximum=F.lit(c.maximum_seniority)))


def _number(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def experience(c: HardFilterConfig) -> Column:
    years = F.array_max(F.transform(F.filter("experience_requirements", lambda r: r["level"] == "REQUIRED"), lambda r: F.coalesce(r["minimum_years"], F.lit(0.0))))
    most = f"{c.maximum_required_experience_years:g}"
    details = F.concat(F.lit("Mandatory minimum experience "), _number(years), F.lit(f" years exceeds configured maximum {most}."))
    return _when(years > c.maximum_required_experience_years, reason("EXPERIENCE_EXCEEDS_MAXIMUM", "experience", details, requiredYears=years, maximumYears=F.lit(float(c.maximum_required_experience_years))))


def phd(p: Candidate, c: HardFilterConfig) -> Column:
    if c.allow_mandatory_phd or "doctorate" in p.education_levels:
        return F.array().cast(f"array<{REASON}>")
    first = F.get(F.filter("education_requirements", lambda r: (r["level"] == "doctorate") & (r["requirement"] == "REQUIRED") & ~r["accepts_equivalent_experience"]), F.lit(0))
    return _when(first.isNotNull(), reason("PHD_REQUIRED", "education", "A doctorate is explicitly mandatory.", evidence=first["evidence"]))


def _first_equal(values: list[str], name, key: Column) -> Column:
    """The first listed value whose key is equal."""
    out = F.lit(None).cast("string")
    for value in reversed(values):
        out = F.when(key == name(value), value).otherwise(out)
    return out


def company(c: HardFilterConfig) -> Column:
    match = _first_equal(c.excluded_companies, lambda v: company_key_of(v, c.company_legal_suffixes), F.col("company_key"))
    return _when(match.isNotNull(), reason("EXCLUDED_COMPANY", "company", F.concat(F.lit("Company is explicitly excluded: "), match, F.lit(".")), company=F.col("company")))


def industry(c: HardFilterConfig) -> Column:
    match = _first_equal(c.excluded_industries, key_of, comparison_key(F.col("industry")))
    unknown = reason("EXCLUDED_INDUSTRY", "industry", "Industry is unknown and configuration rejects unknown industries.", industry=F.lit(None).cast("string"))
    found = reason("EXCLUDED_INDUSTRY", "industry", F.concat(F.lit("Industry is explicitly excluded: "), match, F.lit(".")), industry=F.col("industry"))
    return F.when(F.col("industry").isNull(), _when(F.lit(c.reject_unknown_industry), unknown)).otherwise(_when(match.isNotNull(), found))


def title(c: HardFilterConfig) -> Column:
    key = comparison_key(F.col("cleaned_title"))
    match = F.lit(None).cast("string")
    for phrase in reversed(c.excluded_title_phrases):
        match = F.when(F.concat(F.lit(" "), key, F.lit(" ")).contains(f" {key_of(phrase)} "), phrase).otherwise(match)
    return _when(match.isNotNull(), reason("EXCLUDED_TITLE_PATTERN", "title", F.concat(F.lit("Title matched excluded phrase: "), match, F.lit(".")), title=F.col("cleaned_title"), pattern=match))


def expiry(processing_time: str) -> Column:
    at = F.try_to_timestamp(F.col("expires_at").cast("string"))
    said = reason("JOB_EXPIRED", "expiration", "Job expiration is at or before the processing time.", expiresAt=F.col("expires_at").cast("string"), processingTime=F.lit(processing_time))
    return _when(at <= F.lit(processing_time).cast("timestamp"), said)


def _filters(candidate: Candidate, config: HardFilterConfig, processing_time: str) -> Column:
    parts = [country(config), work_authorization(candidate), language(candidate, config), seniority(config), experience(config), phd(candidate, config), company(config), industry(config), title(config), expiry(processing_time)]
    return F.concat(*(p.cast(f"array<{REASON}>") for p in parts))


def hard_filters(normalized: DataFrame, candidate: Candidate, config: HardFilterConfig, processing_time: str) -> DataFrame:
    """normalized plus reasons and filter_decision (ELIGIBLE or REJECTED)."""
    reasons = held(f"filters {candidate} {config} {processing_time}", lambda: _filters(candidate, config, processing_time))
    out = normalized.withColumn("reasons", reasons)
    return out.withColumn("filter_decision", F.when(F.size("reasons") > 0, "REJECTED").otherwise("ELIGIBLE"))
