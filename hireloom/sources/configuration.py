"""Configuration: YAML sections to checked settings, all problems at once.

Four sections are read from a folder, {section}.yaml or {section}.example.yaml:
profile, search, scoring and sources. This is driver work on small files; what comes
of it enters plans as literals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml

from ..operators import vocabulary as V
from ..operators.filters import Candidate
from ..operators.normalize import HardFilterConfig

SECTIONS = ("profile", "search", "scoring", "sources")
SAFE_ID = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
SOURCE_TYPES = ("greenhouse", "lever", "generic-jsonld", "generic-page", "generic-job-list")
WEIGHTS = ("titleRelevance", "skills", "experience", "location", "workAuthorization", "education", "language", "companyPreference", "freshness", "salary", "sourceQuality", "applicationSimplicity")
#: Defaults where the search section has no hard filters.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]
LEGAL_SUFFIXES = ["Ltd", "Limited", "LLC", "Inc", "Incorporated", "GmbH", "AG", "BV", "PLC"]
#: Setting: lower and upper bound, default.
SOURCE_BOUNDS = {"requestTimeoutMs": (1000, 60_000, 15_000), "browserTimeoutMs": (3000, 90_000, 30_000), "maxDiscoveredLinks": (1, 200, 50), "maxTraversalDepth": (0, 2, None)}


@dataclass(frozen=True)
class Issue:
    code: str
    section: str
    path: str
    message: str


class ConfigurationError(Exception):
    def __init__(self, issues: list[Issue]):
        super().__init__("; ".join(f"{i.section}:{i.path}: {i.message}" for i in issues))
        self.issues = issues


class _Loader(yaml.SafeLoader):
    """Safe YAML in which a key may not repeat, with 50 aliases at most."""

    aliases = 0

    def compose_node(self, parent, index):
        if self.check_event(yaml.AliasEvent):
            self.aliases += 1
            if self.aliases > 50:
                raise yaml.YAMLError("too many aliases")
        return super().compose_node(parent, index)

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep) for k, _ in node.value]
        if len(keys) != len(set(map(str, keys))):
            raise yaml.YAMLError("a key repeats")
        return super().construct_mapping(node, deep)


def read_section(folder: str | Path, section: str, examples: bool = False) -> str:
    path = Path(folder) / f"{section}{'.example' * examples}.yaml"
    try:
        return path.read_text(encoding="utf-8")
    except FileNotFoundError:
        raise ConfigurationError([Issue("CONFIG_FILE_MISSING", section, path.name, "The file does not exist.")]) from None
    except OSError:
        raise ConfigurationError([Issue("CONFIG_FILE_UNREADABLE", section, path.name, "The file cannot be read.")]) from None


def parse_yaml(text: str, section: str) -> dict:
    try:
        value = yaml.load(text, _Loader)  # noqa: S506  a safe loader
    except yaml.YAMLError:
        raise ConfigurationError([Issue("CONFIG_YAML_INVALID", section, "", "The file is no valid YAML.")]) from None
    if not isinstance(value, dict):
        raise ConfigurationError([Issue("CONFIG_SCHEMA_INVALID", section, "", "A mapping is expected.")])
    return value


def field_path(parts: list[str | int]) -> str:
    """a.b[0].c"""
    out = ""
    for p in parts:
        out += f"[{p}]" if isinstance(p, int) else f".{p}" if out else str(p)
    return out


class _Check:
    def __init__(self, section: str, issues: list[Issue]):
        self.section, self.issues = section, issues

    def add(self, path: str, message: str, code: str = "CONFIG_SCHEMA_INVALID") -> None:
        self.issues.append(Issue(code, self.section, path, message))

    def choice(self, value: Any, allowed, path: str) -> None:
        if value not in allowed:
            self.add(path, f"Use one of {', '.join(map(str, allowed))}.")

    def number(self, value: Any, lo: float, hi: float, path: str, whole: bool = False) -> None:
        if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)) or not lo <= value <= hi:
            self.add(path, f"Use a number from {lo} through {hi}.")

    def texts(self, value: Any, path: str, pattern: str = r"[\s\S]*\S[\s\S]*", most: int = 10**6) -> None:
        if not isinstance(value, list) or any(not isinstance(x, str) or not re.fullmatch(pattern, x) or len(x) > most for x in value):
            self.add(path, "Use a list of texts of the expected form.")

    def known(self, value: dict, keys, path: str) -> None:
        for k in value.keys() - set(keys):
            self.add(field_path([path, k]) if path else k, "The key is not known.")


_FILTERS = {
    "allowedCountries": "allowed_countries", "allowedCountryGroups": "allowed_country_groups", "rejectUnknownLocation": "reject_unknown_location", "unknownCandidateLanguageLevelPolicy": "unknown_candidate_language_level_policy",
    "maximumSeniority": "maximum_seniority", "maximumRequiredExperienceYears": "maximum_required_experience_years", "allowMandatoryPhd": "allow_mandatory_phd", "excludedCompanies": "excluded_companies",
    "excludedIndustries": "excluded_industries", "excludedTitlePhrases": "excluded_title_phrases", "rejectUnknownIndustry": "reject_unknown_industry", "removableTrackingParameters": "removable_tracking_parameters", "companyLegalSuffixes": "company_legal_suffixes",
}


def hard_filters(search: dict, issues: list[Issue]) -> HardFilterConfig:
    """The search section's hard filters, checked; permissive defaults where there are none."""
    raw = search.get("preferences", {}).get("hardFilters")
    if raw is None:
        return HardFilterConfig(removable_tracking_parameters=TRACKING, company_legal_suffixes=LEGAL_SUFFIXES)
    c, at = _Check("search", issues), "preferences.hardFilters"
    before = len(issues)
    c.known(raw, _FILTERS, at)
    for k in _FILTERS.keys() - raw.keys():
        c.add(f"{at}.{k}", "The setting is required.")
    if len(issues) > before:
        return HardFilterConfig()
    c.texts(raw["allowedCountries"], f"{at}.allowedCountries", "[A-Z]{2}")
    c.texts(raw["allowedCountryGroups"], f"{at}.allowedCountryGroups", "EU|EEA|EUROPE")
    c.choice(raw["unknownCandidateLanguageLevelPolicy"], ("allow", "reject"), f"{at}.unknownCandidateLanguageLevelPolicy")
    c.choice(raw["maximumSeniority"], V.SENIORITY, f"{at}.maximumSeniority")
    c.number(raw["maximumRequiredExperienceYears"], 0, 80, f"{at}.maximumRequiredExperienceYears")
    for k, most in (("excludedCompanies", 500), ("excludedIndustries", 500), ("excludedTitlePhrases", 100), ("companyLegalSuffixes", 30)):
        c.texts(raw[k], f"{at}.{k}", most=most)
    c.texts(raw["removableTrackingParameters"], f"{at}.removableTrackingParameters", "[A-Za-z0-9_.~-]+")
    for k in ("rejectUnknownLocation", "allowMandatoryPhd", "rejectUnknownIndustry"):
        c.choice(raw[k], (True, False), f"{at}.{k}")
    return HardFilterConfig(**{v: raw[k] for k, v in _FILTERS.items()}) if len(issues) == before else HardFilterConfig()


def candidate(profile: dict, issues: list[Issue]) -> Candidate:
    who, c = profile.get("candidate") or {}, _Check("profile", issues)
    if not SAFE_ID.fullmatch(str(who.get("id", ""))):
        c.add("candidate.id", f'ID "{who.get("id")}" must use lowercase letters, numbers, and single hyphens.')
    for k, x in enumerate(who.get("languages", [])):
        c.choice(x.get("proficiency"), V.LANGUAGE_LEVELS, f"candidate.languages[{k}].proficiency")
    c.texts(who.get("citizenships", []), "candidate.citizenships", "[A-Z]{2}")
    return Candidate(
        education_levels=[x["level"] for x in who.get("education", [])], languages={x["code"]: x["proficiency"] for x in who.get("languages", [])}, citizenships=list(who.get("citizenships", [])),
        work_authorizations=[(x["country"], x["status"]) for x in who.get("workAuthorizations", [])],
    )


def _repeated(values: list[dict], section: str, path: str, issues: list[Issue]) -> None:
    first: dict[str, int] = {}
    for k, value in enumerate(values):
        at = first.setdefault(value.get("id"), k)
        if at != k:
            issues.append(Issue("CONFIG_DUPLICATE_ID", section, f"{path}[{k}].id", f'ID "{value.get("id")}" duplicates {path}[{at}].id.'))
        if not SAFE_ID.fullmatch(str(value.get("id", ""))):
            issues.append(Issue("CONFIG_SCHEMA_INVALID", section, f"{path}[{k}].id", f'ID "{value.get("id")}" must use lowercase letters, numbers, and single hyphens.'))


def cross_checks(search: dict, scoring: dict, sources: dict, issues: list[Issue]) -> None:
    """What holds between entries and between files."""
    tracks, prefs, listed = search.get("tracks", []), search.get("preferences", {}), sources.get("sources", [])
    _repeated(tracks, "search", "tracks", issues)
    on = [t for t in tracks if t.get("enabled")]
    if not on:
        issues.append(Issue("CONFIG_REFERENCE_INVALID", "search", "tracks", "At least one search track must be enabled."))
    daily, quota = prefs.get("dailyRecommendationLimit", 0), sum(t.get("recommendationQuota") or 0 for t in on)
    if quota > daily:
        issues.append(Issue("CONFIG_RANGE_INVALID", "search", "tracks.recommendationQuota", f"Enabled track quotas total {quota}, which exceeds the daily recommendation limit of {daily}."))
    _repeated(listed, "sources", "sources", issues)
    ids = {t.get("id") for t in tracks}
    for k, s in enumerate(listed):
        for j, t in enumerate(s.get("trackIds", [])):
            if t not in ids:
                issues.append(Issue("CONFIG_REFERENCE_INVALID", "sources", f"sources[{k}].trackIds[{j}]", f'Source "{s.get("id")}" references unknown track "{t}".'))
    if not any(s.get("enabled") for s in listed):
        issues.append(Issue("CONFIG_REFERENCE_INVALID", "sources", "sources", "At least one source must be enabled."))
    total = sum(scoring.get("weights", {}).get(k, 0) for k in WEIGHTS)
    if abs(total - 100) > 1e-9:
        issues.append(Issue("CONFIG_WEIGHT_TOTAL_INVALID", "scoring", "weights", f"Scoring weights must total 100; received {total}."))
    if not prefs.get("willingToRelocate") and prefs.get("relocationCountries"):
        issues.append(Issue("CONFIG_REFERENCE_INVALID", "search", "preferences.relocationCountries", "Relocation countries require willingToRelocate to be true."))
    if prefs.get("maximumRecommendationsPerCompany", 0) > daily:
        issues.append(Issue("CONFIG_RANGE_INVALID", "search", "preferences.maximumRecommendationsPerCompany", "Maximum recommendations per company cannot exceed the daily limit."))


def check_sources(sources: dict, issues: list[Issue]) -> None:
    c = _Check("sources", issues)
    for k, s in enumerate(sources.get("sources", [])):
        at = f"sources[{k}]"
        c.choice(s.get("type"), SOURCE_TYPES, f"{at}.type")
        settings = s.get("settings", {})
        for name, (lo, hi, _) in SOURCE_BOUNDS.items():
            value, path = (s.get(name), f"{at}.{name}") if name == "requestTimeoutMs" else (settings.get(name), f"{at}.settings.{name}")
            if value is not None:
                c.number(value, lo, hi, path, whole=True)
        rate = s.get("requestsPerSecond")
        if rate is not None and not 0 < rate <= 10:
            c.add(f"{at}.requestsPerSecond", "Use a number above 0, 10 at most.")


def collectable(sources: dict, ids: set[str] | None = None, kind: str | None = None) -> list[dict]:
    """Enabled sources of a selection with defaults filled in; the legacy type has none."""
    listed = sources.get("sources", [])
    unknown = (ids or set()) - {s["id"] for s in listed}
    if unknown:
        raise ConfigurationError([Issue("SOURCE_NOT_FOUND", "sources", "sources", f"Unknown source {', '.join(sorted(unknown))}.")])
    out = []
    for s in listed:
        if s["enabled"] and s["type"] != "generic-jsonld" and (not ids or s["id"] in ids) and kind in (None, s["type"]):
            web = {"browserTimeoutMs": 30_000, "maxDiscoveredLinks": 50, "maxTraversalDepth": int(s["type"] == "generic-job-list"), "allowBrowserFallback": True} if s["type"].startswith("generic") else {}
            out.append({"company": s["displayName"], "requestTimeoutMs": 15_000, "requestsPerSecond": 2} | s | {"settings": web | s.get("settings", {})})
    if not out:
        raise ConfigurationError([Issue("NO_SOURCES", "sources", "sources", "No source is selected.")])
    return out


def load_configuration(folder: str | Path, examples: bool = False) -> tuple[Candidate, HardFilterConfig, dict]:
    """(candidate, hard filters, raw sections); raises once with the problems of all files."""
    issues: list[Issue] = []
    raw: dict[str, dict] = {}
    for section in SECTIONS:
        try:
            raw[section] = parse_yaml(read_section(folder, section, examples), section)
        except ConfigurationError as e:
            issues += e.issues
    if issues:
        raise ConfigurationError(issues)
    who, filters = candidate(raw["profile"], issues), hard_filters(raw["search"], issues)
    check_sources(raw["sources"], issues)
    cross_checks(raw["search"], raw["scoring"], raw["sources"], issues)
    if issues:
        raise ConfigurationError(issues)
    return who, filters, raw


def summarize(raw: dict) -> dict:
    return {
        "candidate": raw["profile"]["candidate"].get("displayName"), "enabledTracks": sum(bool(t.get("enabled")) for t in raw["search"]["tracks"]),
        "enabledSources": sum(bool(s.get("enabled")) for s in raw["sources"]["sources"]), "dailyRecommendationLimit": raw["search"]["preferences"]["dailyRecommendationLimit"],
    }
