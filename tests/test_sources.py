import json

from pyspark.sql import functions as F

from hireloom.operators import store
from hireloom.operators.collect import normalize_candidates, source_counts
from hireloom.sources.boards import board_a, board_b, invalid_envelopes
from hireloom.sources.crawl import crawl
from hireloom.sources.pages import blocked_reason, job_postings, links, semantic_jobs

AT = "2026-07-29T10:00:00.000Z"


def test_board_a(spark):
    jobs = [{"id": 1, "title": "Engineer", "absolute_url": "https://b.test/1", "content": "<p>Hi</p>", "location": {"name": "Rome"}, "departments": [{"name": "IT"}]}, {"id": 2, "title": 7, "absolute_url": "https://b.test/2"}, {"id": "1", "title": "Again", "absolute_url": "https://b.test/3"}]
    rows = board_a(spark.createDataFrame([("s", "Co", json.dumps({"jobs": jobs})), ("bad", "Co", "[")], "source_id string, company string, body string"))
    good = normalize_candidates(rows.where("NOT invalid AND NOT repeated"), F.lit("greenhouse"), AT).collect()
    assert [(r.external_id, r.title, r.description, r.rejected) for r in good] == [("1", "Engineer", "Hi", None)]
    assert json.loads(good[0].metadata) == {"collector": "greenhouse", "locationText": "Rome", "department": "IT"}
    assert rows.where("invalid").count() == 1 and rows.where("repeated").count() == 1
    assert [r.source_id for r in invalid_envelopes(spark.createDataFrame([("bad", "Co", "[")], "source_id string, company string, body string"), "$.jobs").collect()] == ["bad"]


def test_board_b(spark):
    jobs = [{"id": "a", "text": "Dev", "hostedUrl": "https://b.test/a", "createdAt": 0, "workplaceType": "On-Site", "categories": {"commitment": "Full time"}}, {"id": "b", "text": "Dev", "hostedUrl": "http://b.test/a"}]
    rows = board_b(spark.createDataFrame([("s", "Co", json.dumps(jobs))], "source_id string, company string, body string"))
    good = {r.external_id: r for r in normalize_candidates(rows.where("NOT invalid AND NOT repeated"), F.lit("lever"), AT).collect()}
    assert (good["a"].published_at, good["a"].remote_policy, good["a"].employment_type) == ("1970-01-01T00:00:00.000Z", "onsite", "full-time")
    assert good["b"].rejected == "Job URL must use HTTPS."
    n = source_counts(normalize_candidates(rows, F.lit("lever"), AT)).first()
    assert (n.raw_job_count, n.invalid_job_count, n.candidate_count) == (2, 1, 1)


def test_json_ld_and_links(spark):
    ld = {"@graph": [{"@type": ["Thing", "JobPosting"], "title": "Dev", "description": "Do", "hiringOrganization": {"name": "Org"}, "identifier": {"value": 5}, "jobLocation": {"address": {"addressLocality": "Rome", "addressCountry": "IT"}}, "url": "/jobs/1#x"}, {"@type": "Other"}]}
    html = f'<script type="application/ld+json">{json.dumps(ld)}</script><script type="application/ld+json">{{</script><main><a href="/jobs/2#a">Dev</a><a href="/privacy/jobs">x</a><a href="/jobs/2">Dev</a><a href="https://jobs.lever.co/x">Engineer</a><a href="/jobs/2/apply">Apply</a></main>'
    pages = spark.createDataFrame([("https://x.test/a", html, "Co")], "url string, html string, company string")
    j = job_postings(pages).collect()
    assert [(r.title, r.company, r.external_id, r.location_text, r.canonical_url, r.valid) for r in j] == [("Dev", "Org", "5", "Rome, IT", "https://x.test/jobs/1", True)]
    assert [(r.link, r.reason) for r in links(pages).orderBy("pos").collect()] == [("https://x.test/jobs/2", "job-like-path"), ("https://jobs.lever.co/x", "job-like-anchor-text")]


def test_semantic_blocked_and_crawl(spark):
    body = '<html><article><h1>Dev</h1><p>Work &amp; play</p><a href="/apply">Apply now</a></article></html>'
    pages = spark.createDataFrame([("https://x.test/jobs/1", body, "Co"), ("https://x.test/", '<main><a href="/jobs/1">One</a></main>', "Co"), ("https://x.test/c", "<h1>CAPTCHA</h1>", "Co")], "url string, html string, company string")
    s = {r.url: r for r in semantic_jobs(pages).collect()}["https://x.test/jobs/1"]
    assert (s.title, s.company, s.application_url, s.confidence) == ("Dev", "Co", "https://x.test/apply", 0.9) and "Work & play" in s.description
    assert [r.b for r in pages.select(blocked_reason(F.col("html")).alias("b")).collect()] == [None, None, "captcha"]
    reached = crawl(pages, spark.createDataFrame([("https://x.test/", 1)], "url string, depth int")).visits.collect()
    assert {(r.url, r.depth) for r in reached} == {("https://x.test/", 0), ("https://x.test/jobs/1", 1)}


def test_store(spark):
    rows = spark.createDataFrame([((1, "a"), (1, "b")), ((1, "a"), (None, "a"))], "old struct<x:int,y:string>, new struct<x:int,y:string>")
    assert [r.c for r in rows.select(store.changed_fields(["x", "y"]).alias("c")).collect()] == [["y"], []]
    assert rows.select(store.revision_snapshot(["x", "y"]).alias("s")).first().s == '{"y":{"before":"a","after":"b"}}'
    incoming = spark.createDataFrame([(1, "s", "e1", "u1", "c9", "f9"), (2, "s", "e9", "u9", "c9", "f9"), (3, "s", "e1", "u1", "c2", "f9"), (4, "s", "e1", "u2", "c9", "f1")], "k int, source_id string, external_id string, source_url string, canonical_url string, fingerprint string")
    jobs = spark.createDataFrame([("j1", "c1"), ("j2", "c2")], "id string, canonical_url string")
    refs = spark.createDataFrame([("r1", "s", "e1", "u1", "j1"), ("r2", "s", "e2", "u2", "j1")], "id string, source_id string, external_id string, source_url string, job_id string")
    prints = spark.createDataFrame([("f1", "j1"), ("f1", "j2")], "fingerprint string, job_id string")
    got = {r.k: (r.job_ids, r.reference_id, r.identity) for r in store.resolve_identity(incoming, jobs, refs, prints, "k").collect()}
    assert got == {1: (["j1"], "r1", None), 2: ([], None, "CREATED"), 3: (["j1", "j2"], "r1", "JOB_IDENTITY_CONFLICT"), 4: (["j1", "j2"], "r1", "JOB_IDENTITY_CONFLICT")}


def test_lists_of_places_and_kinds(spark):
    ld = {"@type": "JobPosting", "title": "Dev", "description": "Do", "employmentType": [None, {"a": 1}, "FULL_TIME", "PART_TIME"], "jobLocation": ["Rome", {"address": {"addressLocality": "Paris", "addressCountry": "FR"}}, {"name": "Bern"}, 7]}
    pages = spark.createDataFrame([("https://x.test/a", f'<script type="application/ld+json">{json.dumps(ld)}</script>', "Co")], "url string, html string, company string")
    j = job_postings(pages).first()
    assert (j.location_text, j.employment_type) == ("Rome; Paris, FR; Bern", "FULL_TIME")


def test_numeric_ids(spark):
    jobs = [{"id": x, "title": "T", "absolute_url": "https://b.test/1"} for x in (1.5, 12, 9300000000000000000, "x", True)]
    rows = board_a(spark.createDataFrame([("s", "Co", json.dumps({"jobs": jobs}))], "source_id string, company string, body string"))
    assert sorted(r.external_id for r in rows.where("NOT invalid").collect()) == ["1.5", "12", "9300000000000000000", "x"] and rows.where("invalid").count() == 1


def test_character_references_of_many_digits(spark):
    from hireloom.functions.text import decode_entities

    said = {"&#000000000000000000000065;": "A", "&#x0000000000000000000000041;": "A", "&#65;&#x42;": "AB", "&#0;": "\0", "&#99999999999999999999999;": " ", "&amp;": "&", "&nope;": " "}
    rows = spark.createDataFrame([(k,) for k in said], "t string")
    assert {r.t: r.d for r in rows.select("t", decode_entities(F.col("t")).alias("d")).collect()} == said


def test_registry():
    import pytest

    from hireloom.sources.boards import loader, registry, supported_types

    assert supported_types() == ("greenhouse", "lever") and loader("lever") is board_b
    with pytest.raises(KeyError, match="COLLECTOR_NOT_FOUND"):
        loader("other")
    with pytest.raises(ValueError, match="registered more than once"):
        registry(("a", board_a), ("a", board_b))
