"""Normalization of postings: one wide projection in stages, no shuffle, no Python.

Input columns (snake case of the posting record): id, source_id, external_id,
source_url, canonical_url, application_url, title, company, description, locations
array<struct<country, city, region>>, remote_policy, employment_type, salary_minimum,
salary_maximum, salary_currency, salary_period, published_at, expires_at,
first_seen_at, last_collected_at, metadata (JSON text), input_revision_number.
Each stage is a DataFrame of its own, so that generated code stays small.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_matches, clean, company_key, comparison_key, first_match, held, js, let, matches, metadata_string, presence, replace_all, requirement_level, unique_by
from ..functions.urls import normalize_url
from . import vocabulary as V

ISSUE = "struct<code:string,field:string,severity:string,details:string,evidence:string>"


@dataclass(frozen=True)
class HardFilterConfig:
    """Bounds and lists of the hard filters; the defaults let everything pass."""

    allowed_countries: list[str] = field(default_factory=list)
    allowed_country_groups: list[str] = field(default_factory=list)
    reject_unknown_location: bool = False
    allow_mandatory_phd: bool = True
    reject_unknown_industry: bool = False
    unknown_candidate_language_level_policy: str = "allow"
    maximum_seniority: str = "executive"
    maximum_required_experience_years: float = 80
    excluded_companies: list[str] = field(default_factory=list)
    excluded_industries: list[str] = field(default_factory=list)
    excluded_title_phrases: list[str] = field(default_factory=list)
    removable_tracking_parameters: list[str] = field(default_factory=list)
    company_legal_suffixes: list[str] = field(default_factory=list)


def issue(code: str, name: str, details: Column | str, evidence: Column | None = None, severity: str = "WARNING") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(code).alias("code"), lit(name).alias("field"), F.lit(severity).alias("severity"), lit(details).alias("details"), (F.lit(None).cast("string") if evidence is None else evidence).alias("evidence"))


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first pattern that matches, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(matches(text, pattern), name).otherwise(out)
    return out


def seniority(title: Column) -> Column:
    """struct<level, evidence>; level null where no rule matches or an exclusion does."""
    level = F.when(~matches(title, V.SENIORITY_EXCLUDED), first_rule(title, [(k, p) for k, p, _ in V.SENIORITY_RULES]))
    evidence = F.lit(None).cast("string")
    for k, p, _ in V.SENIORITY_RULES:
        evidence = F.when(level == k, first_match(title, p)).otherwise(evidence)
    return F.struct(level.alias("level"), evidence.alias("evidence"))


def strip_seniority(title: Column, level: Column) -> Column:
    out = title
    for k, p, removed in V.SENIORITY_RULES:
        bare = replace_all(title, removed or p, " ")
        out = F.when(level == k, clean(replace_all(bare, r"^[-,–—:\s]+|[-,–—:\s]+$", ""))).otherwise(out)
    return out


def country_code(value: Column) -> Column:
    """Two letters in upper case as they are, else by alias."""
    table = F.create_map(*[F.lit(x) for kv in V.COUNTRIES.items() for x in kv])
    return let(clean(value), lambda text: F.when(text.rlike("^[A-Za-z]{2}$"), F.upper(text)).otherwise(F.try_element_at(table, F.lower(text))))


def find_country(text: Column) -> Column:
    """The first two-capital word if it is a known code, else the first alias in order.

    One pattern finds all aliases that the text holds; the least place in the list
    of aliases is the first in order, wherever in the text it stands.
    """
    code = first_match(text, r"\b[A-Z]{2}\b", flags="")
    known = F.filter(F.array(code), lambda c: c.isin(sorted(set(V.COUNTRIES.values()))))
    names, codes = F.split(F.lit(",".join(V.COUNTRIES)), ","), F.split(F.lit(",".join(V.COUNTRIES.values())), ",")
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<!\p{{L}})({'|'.join(V.COUNTRIES)})(?!\p{{L}})"), F.lit(1))
    place = F.array_min(F.transform(found, lambda x: F.array_position(names, x)))
    return F.coalesce(F.get(known, F.lit(0)), F.get(codes, (place - 1).cast("int")))


def period(text: Column) -> Column:
    return F.coalesce(first_rule(text, V.PERIODS), F.lit("UNSPECIFIED"))


def gross_net(text: Column) -> Column:
    return F.when(matches(text, r"\bgross\b"), "GROSS").when(matches(text, r"\bnet\b"), "NET").otherwise("UNSPECIFIED")


def amount(text: Column) -> Column:
    """A number with thousands separators dropped; null if it is none."""
    plain = F.regexp_replace(text, r"[,.](?=[0-9]{3}(?:[^0-9]|$))", "")
    plain = F.regexp_replace(plain, r"^([^,]*),", "$1.")
    return F.when(plain.rlike(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), plain.try_cast("double"))


def salary(minimum: Column, maximum: Column, currency: Column, kind: Column, text: Column) -> Column:
    """The structured salary, or one parsed from its text; null if there is neither."""
    word = lambda p, k: first_match(text, p, k)
    lo, hi = amount(word(V.SALARY, 3)), amount(word(V.SALARY, 4))
    parsed = matches(text, V.SALARY) & lo.isNotNull() & (word(V.SALARY, 4).isNull() | hi.isNotNull())
    sign = F.when(word(V.SALARY, 2) == "€", "EUR").when(word(V.SALARY, 2) == "$", "USD").otherwise("GBP")
    none = F.lit(None)

    def record(lo, hi, currency, period, kind, status) -> Column:
        return F.struct(lo.cast("double").alias("minimum_amount"), hi.cast("double").alias("maximum_amount"), currency.cast("string").alias("currency"), period.alias("period"), gross_net(text).alias("gross_net"), kind.alias("kind"), text.alias("original_text"), F.lit(status).alias("parsing_status"))

    shape = F.when(maximum.isNull(), "STARTING").when(minimum.isNull(), "MAXIMUM").when(minimum == maximum, "EXACT").otherwise("RANGE")
    structured = record(minimum, maximum, F.upper(currency), period(kind), shape, "STRUCTURED")
    good = record(lo, hi, F.coalesce(F.upper(word(V.SALARY, 1)), sign), period(text), F.when(hi.isNull(), "EXACT").otherwise("RANGE"), "PARSED")
    bad = record(none, none, none, F.lit("UNSPECIFIED"), F.lit("UNKNOWN"), "UNPARSEABLE")
    return F.when(minimum.isNotNull() | maximum.isNotNull(), structured).when(text.isNull(), F.lit(None)).when(parsed, good).otherwise(bad)


def _zip(text: Column, pattern: str, groups: int) -> Column:
    return F.arrays_zip(*(all_matches(text, pattern, g).alias(f"g{g}") for g in range(1, groups + 1)))


def experience(text: Column) -> Column:
    def row(x: Column, lo: Column, hi: Column) -> Column:
        return let(clean(x["g1"]), lambda evidence: F.struct(lo.cast("double").alias("minimum_years"), hi.cast("double").alias("maximum_years"), requirement_level(evidence).alias("level"), evidence.alias("evidence")))

    upto = F.transform(_zip(text, V.EXPERIENCE_UP_TO, 2), lambda x: row(x, F.lit(0), x["g2"]))
    span = F.transform(_zip(text, V.EXPERIENCE, 3), lambda x: row(x, x["g2"], presence(x["g3"])))
    return F.concat(upto, span)


def education(text: Column) -> Column:
    found = F.transform(all_matches(text, V.EDUCATION, 1), clean)
    kept = F.filter(found, lambda x: matches(x, V.EDUCATION_GATE))
    level = lambda x: F.when(F.lower(x).rlike(r"ph\.?d|doctorate"), "doctorate").when(F.lower(x).rlike("master"), "master").otherwise("bachelor")
    return F.transform(kept, lambda x: F.struct(level(x).alias("level"), requirement_level(x).alias("requirement"), matches(x, V.EQUIVALENT).alias("accepts_equivalent_experience"), x.alias("evidence")))


def _sentences(text: Column, ends: str) -> Column:
    return F.split(text, f"(?<=[{ends}])")


def languages(text: Column) -> Column:
    """All mentions in gated sentences, those that repeat too; level null if not named."""
    gated = F.filter(_sentences(text, r".!?;\n"), lambda s: matches(s, V.LANGUAGE_GATE))

    found = F.transform(gated, lambda s: F.struct(s.alias("s"), requirement_level(s).alias("requirement"), first_rule(s, V.LANGUAGE_RULES).alias("named"), matches(s, r"\bnative(?:[- ]level| speaker)?\b").alias("native"), clean(s).alias("evidence")))

    def of(x: Column) -> Column:
        rows = [F.when(matches(x["s"], p), F.struct(F.lit(code).alias("code"), F.lit(name).alias("name"), x["named"].alias("named"), x["requirement"].alias("requirement"), x["native"].alias("native_required"), x["evidence"].alias("evidence"))) for code, name, p in V.LANGUAGES]
        return F.array_compact(F.array(*rows))

    return F.flatten(F.transform(found, of))


def skills(text: Column) -> Column:
    """The first mention of each skill, with 80 characters around it."""
    rows = []
    for name, pattern, flags in V.SKILLS:
        at, hit = F.regexp_instr(text, F.lit(js(pattern, flags))), first_match(text, pattern, flags=flags)
        rows.append(F.when(at > 0, F.struct(F.lit(name).alias("name"), at.alias("at"), hit.alias("hit"))))
    near = lambda x: F.substring(text, F.greatest(x["at"] - 80, F.lit(1)), x["at"] + F.length(x["hit"]) + 80 - F.greatest(x["at"] - 80, F.lit(1)))
    found = F.transform(F.array_compact(F.array(*rows)), lambda x: F.struct(x["name"].alias("name"), x["hit"].alias("hit"), clean(near(x)).alias("evidence")))
    return F.transform(found, lambda x: F.struct(x["name"].alias("canonical_name"), x["hit"].alias("original_spelling"), requirement_level(x["evidence"]).alias("requirement"), x["evidence"].alias("evidence")))


def authorization(text: Column) -> Column:
    gated = F.filter(_sentences(text, r".!?\n"), lambda s: matches(s, V.AUTHORIZATION_GATE))

    def of(x: Column) -> Column:
        e, country = x["e"], x["country"]
        sponsored = F.when(matches(e, V.SPONSORED), True).when(matches(e, V.NOT_SPONSORED), False)
        return F.struct(country.alias("country_code"), F.when(country.isNull() & matches(e, r"\beu\b"), "EU").alias("country_group"), sponsored.alias("sponsorship_available"), matches(e, r"\bcitizens? only\b").alias("citizenship_only"), matches(e, V.CLEARANCE).alias("security_clearance_required"), e.alias("evidence"))

    found = F.transform(F.transform(gated, clean), lambda e: F.struct(e.alias("e"), find_country(e).alias("country")))
    return F.transform(found, of)


def normalize(jobs: DataFrame, config: HardFilterConfig) -> DataFrame:
    """jobs with normalized columns, issues and valid: whether normalization succeeded."""
    kind = jobs.schema["locations"].dataType.simpleString()
    for stage in held(f"normalize {config} {kind}", lambda: _stages(config, kind)):
        jobs = jobs.withColumns(stage)
    return jobs.drop("seniority_found", "location_metadata", "full_description", "language_mentions", "textual_policy")


def _stages(config: HardFilterConfig, kind: str) -> list[dict[str, Column]]:
    none = F.lit(None).cast(ISSUE)
    cut = lambda c, n, name: F.when(F.length(c) > n, issue("INPUT_TRUNCATED", name, f"{name} exceeded {n} characters and was truncated.")).otherwise(none)
    # 1: titles, companies, URLs, texts of the metadata
    stages = [{
        "cleaned_title": clean(F.left("title", F.lit(1000))), "normalized_company": clean(F.left("company", F.lit(1000))),
        "identity_url": normalize_url(F.coalesce("application_url", "canonical_url"), config.removable_tracking_parameters, strip_slash=True, sort=True)["value"],
        "location_metadata": metadata_string("metadata", "locationText"), "salary_text": metadata_string("metadata", "salaryText"),
        "industry": metadata_string("metadata", "industry", 500), "department": metadata_string("metadata", "department", 500), "office": metadata_string("metadata", "office", 500),
        "full_description": F.col("description"), "description": F.left("description", F.lit(100_000)),
    }]
    stages.append({"seniority_found": seniority(F.col("cleaned_title"))})
    # 2: keys, location
    first = F.get("locations", F.lit(0))
    parts = F.filter(F.array(first["city"], first["region"], first["country"]), lambda x: F.coalesce(x != "", F.lit(False)))
    original = F.coalesce("location_metadata", F.when(F.size("locations") > 0, F.array_join(parts, ", ")))
    stages.append({"location_original": original, "location_text": clean(F.coalesce(original, F.lit(""))), "seniority": F.col("seniority_found.level"), "seniority_evidence": F.col("seniority_found.evidence"), "normalized_title": strip_seniority(F.col("cleaned_title"), F.col("seniority_found.level"))})
    text = F.col("location_text")
    textual = F.when(matches(text, r"\bhybrid\b"), "hybrid").when(matches(text, r"\bremote\b"), "remote")
    structured = F.array_compact(F.transform(F.coalesce("locations", F.array().cast(kind)), lambda x: country_code(x["country"])))
    codes = F.array_distinct(F.array_compact(F.concat(structured, F.array(find_country(text)))))
    stages.append({"textual_policy": textual, "normalized_policy": F.coalesce("remote_policy", textual, F.lit("unspecified")), "country_codes": codes, "title_key": comparison_key(F.col("normalized_title")), "company_key": company_key(F.col("normalized_company"), config.company_legal_suffixes)})
    scope = (
        F.when(F.col("normalized_policy") != "remote", "UNSPECIFIED").when(matches(text, r"\bworldwide|anywhere\b"), "WORLDWIDE").when(matches(text, r"\beea\b"), "EEA")
        .when(matches(text, r"\beu(?:ropean union)?\b"), "EU").when(matches(text, r"\beurope\b"), "EUROPE").when(matches(text, r"\b(?:time ?zone|utc[+-])\b"), "TIMEZONE")
        .when(F.size("country_codes") == 0, "UNSPECIFIED").otherwise("COUNTRY")
    )
    places = F.transform("locations", lambda x: F.concat_ws(":", F.coalesce(country_code(x["country"]), comparison_key(x["country"])), comparison_key(F.coalesce(x["region"], F.lit(""))), comparison_key(F.coalesce(x["city"], F.lit("")))))
    places = F.when(F.coalesce(F.size("locations"), F.lit(0)) > 0, F.array_sort(places)).otherwise(F.filter(F.array(comparison_key(text)), lambda x: x != ""))
    stages.append({"remote_scope": scope})
    stages.append({"location_key": F.lower(F.concat_ws("|", "normalized_policy", "remote_scope", places))})
    # 3: requirements
    stages.append({
        "salary": salary(F.col("salary_minimum"), F.col("salary_maximum"), F.col("salary_currency"), F.col("salary_period"), F.col("salary_text")),
        "experience_requirements": F.coalesce(experience(F.col("description")), F.array()), "education_requirements": F.coalesce(education(F.col("description")), F.array()),
        "language_mentions": F.coalesce(languages(F.col("description")), F.array()), "skill_requirements": F.coalesce(skills(F.col("description")), F.array()),
        "work_authorization_requirements": F.coalesce(authorization(F.col("description")), F.array()),
    })
    levelled = F.transform("language_mentions", lambda x: F.struct(x["code"], x["name"], F.coalesce(x["named"], F.lit("basic")).alias("proficiency"), x["requirement"], x["native_required"], x["evidence"]))
    stages.append({"language_requirements": unique_by(levelled, lambda x: F.concat_ws("|", x["code"], x["requirement"], x["proficiency"]))})
    # 4: issues, in the order of the steps; a failure replaces all others
    missing = (F.col("cleaned_title") == "") | (F.col("normalized_company") == "") | F.col("cleaned_title").isNull() | F.col("normalized_company").isNull()
    conflict = F.coalesce((F.col("remote_policy") != F.col("textual_policy")), F.lit(False))
    ambiguous = (text != "") & (F.size("country_codes") == 0) & (F.col("remote_scope") == "UNSPECIFIED")
    unknown = F.transform(F.filter("language_mentions", lambda x: x["named"].isNull()), lambda x: issue("UNKNOWN_LANGUAGE_LEVEL", "languages", F.concat(F.lit("An explicit "), x["name"], F.lit(" requirement had no recognized level.")), x["evidence"]))
    single = F.array_compact(F.array(
        cut(F.col("title"), 1000, "title"), cut(F.col("company"), 1000, "company"),
        F.when(conflict, issue("CONFLICTING_REMOTE_POLICY", "location", "Structured and textual remote policies conflict.", text)),
        F.when(ambiguous, issue("AMBIGUOUS_LOCATION", "location", "Location text could not be mapped confidently.", text)),
        F.when(F.length("full_description") > 100_000, issue("INPUT_TRUNCATED", "description", "Description exceeded 100000 characters and was truncated.")),
        F.when(F.col("salary.parsing_status") == "UNPARSEABLE", issue("UNPARSEABLE_SALARY", "salary", "Explicit salary text could not be parsed without assumptions.", F.col("salary_text"))),
    ))
    failed = F.when(missing, F.array(issue("MISSING_REQUIRED_FIELD", F.when(F.coalesce(F.col("cleaned_title"), F.lit("")) == "", "title").otherwise("company"), "A non-empty title and company are required.", severity="ERROR"))).when(F.col("identity_url").isNull(), F.array(issue("INVALID_APPLICATION_URL", "applicationUrl", "The canonical application URL is invalid.", F.coalesce("application_url", "canonical_url"), "ERROR")))
    stages.append({"issues": F.coalesce(failed, F.concat(single, unknown)), "valid": ~missing & F.col("identity_url").isNotNull(), "country_code": F.get("country_codes", F.lit(0))})
    return stages
