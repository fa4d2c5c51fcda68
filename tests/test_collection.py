"""Collections from sources to the store's versions, and the command that runs them."""

import json

from pyspark.sql import functions as F

from hireloom.__main__ import main
from hireloom.operators import collection as C
from hireloom.operators import runs, upsert

SOURCES = "source_id string, type string, company string, url string, enabled boolean"


def frames(spark, title="Engineer", broken="["):
    board = json.dumps({"jobs": [{"id": 1, "title": title, "absolute_url": "https://b.test/1", "content": "<p>Hi</p>"}, {"id": 2, "title": 7, "absolute_url": "https://b.test/2"}, {"id": 1, "title": "Again", "absolute_url": "https://b.test/3"}]})
    lever = json.dumps([{"id": "x", "text": "Dev", "hostedUrl": "https://l.test/x"}])
    sources = [("a", "greenhouse", "A", None, True), ("b", "lever", "B", None, None), ("c", "greenhouse", "C", None, True), ("d", "lever", "D", None, True), ("e", "generic-job-list", "E", "https://e.test/", True), ("f", "generic-page", "F", "https://f.test/", True), ("g", "other", "G", None, True), ("h", "greenhouse", "H", None, False)]
    pages = [("https://e.test/", '<ul class="jobs"><li><a href="/jobs/1">x</a></ul>', None), ("https://e.test/jobs/1", "<article><h1>Analyst</h1><p>Text</p></article>", None), ("https://f.test/", "<h1>Access denied</h1>", None)]
    return spark.createDataFrame(sources, SOURCES), spark.createDataFrame([("a", board), ("b", lever), ("c", broken), ("h", board)], "source_id string, body string"), spark.createDataFrame(pages, "url string, html string, rendered string")


def test_sources_of_all_types_and_two_runs(spark, tmp_path):
    path = f"{tmp_path}/store"
    first = C.collect(spark, path, *frames(spark))
    assert (first["status"], first["attempted_source_count"], first["succeeded_source_count"], first["failed_source_count"]) == ("PARTIALLY_FAILED", 7, 3, 4)
    assert (first["raw_jobs_found"], first["created_jobs"], first["invalid_jobs"]) == (5, 3, 2)
    assert {e["sourceId"]: e["code"] for e in json.loads(first["error_summary"])} == {"c": "SOURCE_RESPONSE_INVALID", "d": "SOURCE_UNAVAILABLE", "f": "BLOCK_PAGE_DETECTED", "g": "COLLECTOR_NOT_FOUND"}
    second = C.collect(spark, path, *frames(spark, title="Senior Engineer", broken='{"jobs": []}'))
    assert (second["created_jobs"], second["updated_jobs"], second["unchanged_jobs"], second["failed_source_count"]) == (0, 1, 2, 3)
    got = C.gather(*frames(spark), "2026-07-29T10:00:00.000Z")
    store = C.load_store(spark, path, got.postings)
    assert {(r.title, r.company) for r in store.jobs.collect()} == {("Senior Engineer", "A"), ("Dev", "B"), ("Analyst", "E")}
    assert [json.loads(r.snapshot)["title"] for r in store.revisions.collect()] == [{"before": "Engineer", "after": "Senior Engineer"}] and store.references.count() == 3
    assert {json.loads(r.metadata)["collector"] for r in store.jobs.collect()} == {"greenhouse", "lever", "generic-job-list"}
    assert [r.status for r in runs.runs(spark, f"{path}/runs").collect()] == ["PARTIALLY_FAILED"] * 2


def test_a_run_that_dies_leaves_nothing_that_is_read(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/store"
    monkeypatch.setattr(upsert, "stored_results", lambda *_: 1 / 0)
    try:
        C.collect(spark, path, *frames(spark))
    except ZeroDivisionError:
        pass
    got = C.gather(*frames(spark), "2026-07-29T10:00:00.000Z")
    assert C.load_store(spark, path, got.postings).jobs.count() == 0
    assert [r.status for r in runs.runs(spark, f"{path}/runs").collect()] == ["FAILED"]


def test_command(spark, tmp_path, capsys):
    for name, df in zip(("sources", "bodies", "pages"), frames(spark), strict=True):
        (df.where("source_id IN ('a', 'b')") if name == "sources" else df).write.parquet(f"{tmp_path}/{name}")
    args = ["collect", "--json", "--store", f"{tmp_path}/store", *(x for n in ("sources", "bodies", "pages") for x in (f"--{n}", f"{tmp_path}/{n}"))]
    assert main(args) == 0
    said = json.loads(capsys.readouterr().out)
    assert (said["status"], said["created_jobs"]) == ("COMPLETED", 2)


def test_configured_sources_over_stored_ones(spark):
    kind = "config_source_id string, display_name string"
    out = upsert.upsert_sources(spark.createDataFrame([("a", "new"), ("c", "added")], kind), spark.createDataFrame([("a", "old"), ("b", "stays")], kind))
    assert sorted(map(tuple, out.select("config_source_id", F.col("display_name")).collect())) == [("a", "new"), ("b", "stays"), ("c", "added")]
