"""Crawls of many small sites at once: budgets, order, gating, rendered pages, failures, metadata."""

import json

import pytest
from pyspark.sql import functions as F

from hireloom.plans.page_queries import crawled_sites
from hireloom.sources import elements
from hireloom.sources.crawl import _met, _ranked, crawl, page_postings
from hireloom.sources.pages import extract

AT = "2026-07-29T10:00:00.000Z"
SHELL = '<div id="root"></div><script type="module" src="a.js"></script>'


def ld(obj, raw=False):
    return f'<script type="application/ld+json">{obj if raw else json.dumps(obj)}</script>'


def job(title="Dev", **more):
    return {"@type": "JobPosting", "title": title, "description": "Do", "hiringOrganization": "Org"} | more


def listing(*paths):
    return '<ul class="jobs">' + "".join(f'<li><a href="{p}">Job</a>' for p in paths) + "</ul>"


def sites():
    """{source: ({path: (html, rendered)}, settings)}."""
    out = {f"s{k}": ({"/": (listing("/jobs/1"), None), "/jobs/1": (ld(job(f"J{k}")), None)}, {}) for k in range(80)}
    out["big"] = ({"/": (listing(*(f"/jobs/{k}" for k in range(90))), None)} | {f"/jobs/{k}": (ld(job(f"B{k}")), None) for k in range(90) if k != 3}, {"most_links": 100})
    out["few"] = ({"/": (listing(*(f"/jobs/{k}" for k in range(9))), None)} | {f"/jobs/{k}": ("<p>x", None) for k in range(9)}, {"most_links": 4})
    out["page"] = ({"/": (listing("/jobs/1") + ld(job()), None), "/jobs/1": (ld(job("No")), None)}, {"is_list": False})
    out["deep"] = ({"/": (listing("/jobs/a", "/jobs/b"), None), "/jobs/a": (listing("/jobs/b", "/jobs/c", "/jobs/d", "/"), None), "/jobs/b": (listing("/jobs/d", "/jobs/e", "/jobs/f"), None), "/jobs/c": (listing("/jobs/z"), None), "/jobs/d": (ld(job("D")), None), "/jobs/e": (ld(job("Again", url="/jobs/d")), None)}, {"most_links": 5})
    out["shell"] = ({"/": (listing("/jobs/1", "/jobs/2"), None), "/jobs/1": (SHELL, "<main><h1>Rendered</h1><p>Text</p></main>"), "/jobs/2": (SHELL, None)}, {})
    out["nobrowser"] = ({"/": (SHELL, "<main><h1>Rendered</h1><p>Text</p></main>")}, {"allow_browser": False})
    out["shells"] = ({"/": (listing(*(f"/jobs/{k}" for k in range(12))), None)} | {f"/jobs/{k}": (SHELL, f"<main><h1>R{k:02}</h1><p>Text</p></main>") for k in range(12)}, {})
    out["blocked"] = ({"/": ("<h1>Verify you are human</h1>" + listing("/jobs/1"), None)}, {})
    out["gone"] = ({}, {})
    out["halfblocked"] = ({"/": (listing("/jobs/1"), None), "/jobs/1": ("<h1>Access denied</h1>" + ld(job()), None)}, {})
    out["ats"] = ({"/": ('<main><a href="https://jobs.lever.co/x">Engineer</a><a href="https://boards.greenhouse.io/y">Engineer</a><a href="https://api.lever.co/z">Engineer</a></main>', None)}, {"depth": 0})
    out["bad"] = ({"/": (ld("{", raw=True) + ld([job(None), [{"@graph": [[job("G", directApply=True, industry="IT", occupationalCategory=5, baseSalary={"value": {"minValue": 1}}, datePosted="x")]]}]]) + ld("x" * 600_000, raw=True), None)}, {})
    return out


@pytest.fixture(scope="module")
def crawled(spark):
    pages, roots = [], []
    for s, (some, settings) in sites().items():
        pages += [(f"https://{s}.test{p}", html, rendered) for p, (html, rendered) in some.items()]
        roots.append((s, f"https://{s}.test/", "Co", settings.get("is_list", True), settings.get("depth", 2), settings.get("most_links", 50), settings.get("allow_browser", True)))
    pages = spark.createDataFrame(pages + pages[:3], "url string, html string, rendered string")
    roots = spark.createDataFrame(roots + roots[:3], "source_id string, url string, company string, is_list boolean, depth int, most_links int, allow_browser boolean")
    good, found = page_postings(pages, roots, F.lit("generic-job-list"), AT)
    by = {}
    for name, df in (("visits", found.visits.orderBy("ordinal")), ("warnings", found.warnings.orderBy("nth")), ("errors", found.errors), ("postings", found.postings.orderBy("ordinal", "nth")), ("stored", good)):
        for r in df.collect():
            by.setdefault(r.source_id, {}).setdefault(name, []).append(r)
    return by


def paths(rows):
    return [r.url.split(".test")[1] for r in rows]


def test_sources_do_not_share_budgets(crawled):
    assert sum(len(crawled[f"s{k}"]["visits"]) for k in range(80)) == 160
    assert all([r.title for r in crawled[f"s{k}"]["postings"]] == [f"J{k}"] and "warnings" not in crawled[f"s{k}"] for k in range(80))


def test_page_and_link_budgets(crawled):
    big = crawled["big"]
    assert paths(big["visits"]) == ["/", *(f"/jobs/{k}" for k in range(59))]  # the root is one of sixty
    assert [r.title for r in big["postings"]] == [f"B{k}" for k in range(59) if k != 3]  # one is not there
    assert sorted(r.code for r in big["warnings"]) == ["PAGE_EXTRACTION_FAILED", "TRAVERSAL_LIMIT_REACHED"]
    assert paths(crawled["few"]["visits"]) == ["/", *(f"/jobs/{k}" for k in range(4))]
    assert paths(crawled["page"]["visits"]) == ["/"] and [r.message for r in crawled["page"]["warnings"]] == ["TRAVERSAL_LIMIT_REACHED"]


def test_breadth_first_order_and_first_of_a_url(crawled):
    deep = crawled["deep"]
    assert [(r.depth, p) for r, p in zip(deep["visits"], paths(deep["visits"]), strict=True)] == [(0, "/"), (1, "/jobs/a"), (1, "/jobs/b"), (2, "/jobs/c"), (2, "/jobs/d"), (2, "/jobs/e")]
    assert [r.title for r in deep["postings"]] == ["D"]  # /jobs/e says it is /jobs/d
    assert [(r.ordinal, r.code) for r in deep["warnings"]] == [(2, "TRAVERSAL_LIMIT_REACHED")]  # /jobs/f is a sixth


def test_rendered_pages(crawled):
    shell = crawled["shell"]
    assert [r.rendered for r in shell["visits"]] == [None, True, False] and [r.title for r in shell["postings"]] == ["Rendered"]
    assert [r.code for r in shell["warnings"]] == ["BROWSER_FALLBACK_FAILED"]
    assert "postings" not in crawled["nobrowser"]
    assert [r.title for r in crawled["shells"]["postings"]] == [f"R{k:02}" for k in range(10)]  # ten renderings


def test_blocked_and_missing(crawled):
    assert [(r.code, r.message) for r in crawled["blocked"]["errors"]] == [("BLOCK_PAGE_DETECTED", "Generic source returned a captcha page.")]
    assert paths(crawled["blocked"]["visits"]) == ["/"] and "postings" not in crawled["blocked"]
    assert [r.code for r in crawled["gone"]["errors"]] == ["PAGE_EXTRACTION_FAILED"]
    assert "errors" not in crawled["halfblocked"] and [r.message for r in crawled["halfblocked"]["warnings"]] == ["Blocked page detected: access-denied."]


def test_warnings_in_order_and_metadata(crawled):
    assert [r.message for r in crawled["ats"]["warnings"]] == ["KNOWN_ATS_DETECTED:lever", "KNOWN_ATS_DETECTED:greenhouse", "TRAVERSAL_LIMIT_REACHED"]
    assert [r.code for r in crawled["ats"]["warnings"]] == ["KNOWN_ATS_DETECTED"] * 2 + ["TRAVERSAL_LIMIT_REACHED"]
    assert [r.message for r in crawled["bad"]["warnings"]] == ["A malformed JSON-LD block was skipped.", "An oversized JSON-LD block was skipped.", "A malformed or incomplete JobPosting object was skipped."]
    (stored,) = crawled["bad"]["stored"]
    said = json.loads(stored.metadata)
    assert (stored.title, stored.rejected, stored.external_id, stored.published_at) == ("G", None, "https://bad.test/", None)
    assert (said["directApply"], said["industry"], said["occupationalCategory"], json.loads(said["baseSalary"]), said["extractionStrategy"]) == ("true", "IT", "5", {"value": {"minValue": 1}}, "json-ld")
    assert [e["source"] for e in json.loads(said["evidence"])] == ["json-ld.title", "json-ld.hiringOrganization", "final-url"]


def test_detections_say_the_last_host(spark):
    page = '<main><a href="https://jobs.lever.co/x">Engineer</a><a href="https://api.lever.co/z">Engineer</a></main>'
    r = extract(spark.createDataFrame([("https://s.test/", page, "Co")], "url string, html string, company string")).pages.first()
    assert [(d.provider, d.host) for d in r.detections] == [("lever", "api.lever.co")] and (r.n_links, r.n_postings) == (2, 0)


def test_nothing_to_crawl(spark):
    pages = spark.createDataFrame([], "url string, html string")
    found = crawl(pages, spark.createDataFrame([], "url string, company string"))
    assert found.visits.count() == found.postings.count() == found.warnings.count() == found.errors.count() == 0
    with pytest.raises(ValueError, match="depth"):
        crawl(pages, spark.createDataFrame([("https://x.test/", 3)], "url string, depth int"))


def test_html_and_postings_take_tasks_by_their_size(spark, monkeypatch):
    """pages of a crawl, their states and their postings stay few a task where the session has few tasks."""
    monkeypatch.setattr(elements, "SHARE", 2**14)
    rows = [(f"https://s{k}.test/", f"<main><h1>Job {k}</h1><p>{'text ' * 1500}</p></main>") for k in range(60)]
    pages = spark.createDataFrame(rows, "url string, html string")
    roots = pages.select("url", F.col("url").alias("source_id"), F.lit("Co").alias("company"), F.lit(False).alias("is_list"), F.lit("t").alias("type"))
    good, found = page_postings(pages, roots, F.col("type"), AT)
    read = extract(pages.withColumn("company", F.lit("Co")))
    frontier = roots.select("source_id", "url", "company")
    for part in (_met(frontier, pages, found.tasks), read.pages, read.postings, found.postings, good):
        a_task = [r["count"] for r in part.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(a_task) == 60 and len(a_task) > 15 and max(a_task) < 10


def test_rows_without_html_take_tasks_by_the_size_of_a_crawl(spark, monkeypatch):
    """visits, links, warnings and what is counted of them stay few a task where the session has few tasks."""
    monkeypatch.setattr(elements, "SHARE", 2**14)
    sites = [(f"https://s{k}.test/", f"<p>{'text ' * 1500}</p>" + listing("/jobs/1", "/jobs/2", "/jobs/1")) for k in range(60)]
    pages = spark.createDataFrame(sites + [(f"https://s{k}.test/jobs/1", ld(job(f"J{k}"))) for k in range(60)], "url string, html string")
    found = crawl(pages, pages.where("url NOT LIKE '%jobs%'").select("url", F.lit("Co").alias("company"), F.lit(1).alias("depth")))
    links = found.visits.where("depth = 0").select("source_id", F.explode(F.array(*(F.concat("source_id", F.lit(f"jobs/{k}")) for k in (1, 2)))).alias("link"), "ordinal", F.lit(0).alias("pos"))
    known = found.visits.select("source_id", F.col("url").alias("link"), (F.col("depth") > 0).alias("found")).where("link NOT LIKE '%/jobs/2'")
    ranked = _ranked(links, known, found.tasks)
    assert {(r.link.split("/", 3)[3], r.n, r.n_taken) for r in ranked.collect()} == {("jobs/2", 1, 1)}
    assert ranked.count() == found.postings.count() == found.warnings.count() == 60 and found.visits.count() == 180
    for part, rows in ((found.visits, 180), (found.warnings, 60), (ranked, 60)):
        a_task = [r["count"] for r in part.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(a_task) == rows and len(a_task) > 15 and max(a_task) < rows / 6
    a_task = [r["count"] for r in crawled_sites(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()]
    assert len(a_task) > 6
