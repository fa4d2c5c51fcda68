import copy

import pytest

from hireloom.operators.process import decide
from hireloom.sources.configuration import ConfigurationError, collectable, cross_checks, field_path, hard_filters, parse_yaml, check_sources
from hireloom.streaming.incremental import start
from hireloom.operators.filters import Candidate
from hireloom.operators.normalize import HardFilterConfig

from .model import SCHEMA, job

SEARCH = {"tracks": [{"id": "a", "enabled": True, "recommendationQuota": 3}], "preferences": {"dailyRecommendationLimit": 5, "maximumRecommendationsPerCompany": 1, "willingToRelocate": False, "relocationCountries": []}}
SCORING = {"weights": {"titleRelevance": 60, "skills": 40}}
SOURCES = {"sources": [{"id": "s", "type": "generic-job-list", "enabled": True, "displayName": "S", "trackIds": ["a"], "settings": {"url": "https://x.test"}}, {"id": "old", "type": "generic-jsonld", "enabled": True, "displayName": "O", "trackIds": [], "settings": {}}]}


def codes(change=lambda search, scoring, sources: None):
    search, scoring, sources, issues = copy.deepcopy(SEARCH), copy.deepcopy(SCORING), copy.deepcopy(SOURCES), []
    change(search, scoring, sources)
    check_sources(sources, issues)
    cross_checks(search, scoring, sources, issues)
    return [(i.code, i.path) for i in issues]


def test_cross_checks():
    assert codes() == []
    assert codes(lambda a, b, c: a["tracks"][0].update(recommendationQuota=9)) == [("CONFIG_RANGE_INVALID", "tracks.recommendationQuota")]
    assert codes(lambda a, b, c: b["weights"].update(skills=41)) == [("CONFIG_WEIGHT_TOTAL_INVALID", "weights")]
    assert codes(lambda a, b, c: c["sources"][0].update(trackIds=["a", "b"])) == [("CONFIG_REFERENCE_INVALID", "sources[0].trackIds[1]")]
    assert codes(lambda a, b, c: c["sources"][1].update(id="s")) == [("CONFIG_DUPLICATE_ID", "sources[1].id")]
    assert codes(lambda a, b, c: c["sources"][0]["settings"].update(maxTraversalDepth=3)) == [("CONFIG_SCHEMA_INVALID", "sources[0].settings.maxTraversalDepth")]


def test_yaml_and_paths():
    assert parse_yaml("a: [1]", "search") == {"a": [1]}
    for bad in ("a: 1\na: 2", "[1]", "a: ["):
        with pytest.raises(ConfigurationError):
            parse_yaml(bad, "search")
    assert field_path(["a", "b", 0, "c"]) == "a.b[0].c"


def test_defaults_and_selection():
    issues = []
    assert hard_filters(SEARCH, issues).maximum_seniority == "executive" and not issues
    hard_filters({"preferences": {"hardFilters": {"nope": 1}}}, issues)
    assert ("preferences.hardFilters.nope" in {i.path for i in issues}) and len(issues) == 14
    got = collectable(SOURCES)
    assert [(s["id"], s["company"], s["settings"]["maxTraversalDepth"], s["requestTimeoutMs"]) for s in got] == [("s", "S", 1, 15_000)]
    with pytest.raises(ConfigurationError):
        collectable(SOURCES, {"x"})


def test_stream_appends_each_decision_once(spark, tmp_path):
    rows = spark.createDataFrame([job(1), job(2, title=" ")], SCHEMA)
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    args = (Candidate(), HardFilterConfig(), "2026-07-29T12:00:00.000Z")
    for attempt in ("a", "b"):  # the second has no memory of the first: a run repeated
        start(stream(), str(tmp_path / "out"), str(tmp_path / attempt), *args).awaitTermination()
        got = spark.read.schema(decide(rows.limit(0), *args).schema).parquet(str(tmp_path / "out"))
        assert sorted((r.job_id, r.processing_status) for r in got.collect()) == [("0001", "ELIGIBLE"), ("0002", "NORMALIZATION_FAILED")]
