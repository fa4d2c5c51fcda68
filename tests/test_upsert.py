"""Upserts against a sequential model, and the run's bookkeeping."""

import json
import random

import pytest

from hireloom.operators import store as S
from hireloom.operators import upsert as U

KIND = "position int, id string, source_id string, external_id string, source_url string, canonical_url string, fingerprint string, collected_at string, title string, company string, description string"


def posting(position, source, external, url, title="Engineer", canonical=None, print_=None, at=None, description=None):
    return (position, f"new {position}", source, external, url, canonical or url, print_ or f"f {canonical or url}", at or f"2026-07-29T10:{position:02d}:00.000Z", title, "Example Labs", description)


def model(rows, fields=("title", "company", "description", "canonical_url")):
    """The store one posting at a time."""
    names = [f.split()[0] for f in KIND.split(", ")]
    jobs, refs, prints, revisions, out = {}, [], {}, [], {}
    for r in (dict(zip(names, row, strict=True)) for row in sorted(rows)):
        ext = next((x for x in refs if (x["s"], x["e"]) == (r["source_id"], r["external_id"])), None)
        url = next((x for x in refs if (x["s"], x["u"]) == (r["source_id"], r["source_url"])), None)
        found = {x["job"] for x in (ext, url) if x} | {k for k, j in jobs.items() if j["canonical_url"] == r["canonical_url"]} | ({prints[r["fingerprint"]]} if r["fingerprint"] in prints else set())
        at = r["collected_at"]
        if len(found) > 1:
            out[r["position"]] = (None, "JOB_IDENTITY_CONFLICT", None)
            continue
        if not found:
            jobs[r["id"]] = {f: r[f] for f in fields} | {"first": at, "last": at}
            refs.append({"s": r["source_id"], "e": r["external_id"], "u": r["source_url"], "job": r["id"], "last": at})
            prints[r["fingerprint"]] = r["id"]
            out[r["position"]] = (r["id"], "CREATED", None)
            continue
        (k,) = found
        ref = ext or url
        if ref is None:
            refs.append({"s": r["source_id"], "e": r["external_id"], "u": r["source_url"], "job": k, "last": at})
        else:
            ref["last"] = max(ref["last"], at)
        changed = [f for f in S.MEANINGFUL if f in fields and r[f] is not None and r[f] != jobs[k][f]]
        jobs[k]["last"] = max(jobs[k]["last"], at)
        prints.setdefault(r["fingerprint"], k)
        if changed:
            jobs[k] |= {f: r[f] for f in fields if r[f] is not None}
            n = 1 + sum(v[0] == k for v in revisions)
            revisions.append((k, n, tuple(changed)))
            out[r["position"]] = (k, "UPDATED", n)
        else:
            out[r["position"]] = (k, "LINKED_TO_EXISTING" if ref is None else "UNCHANGED", None)
    return jobs, refs, revisions, out


def test_created_unchanged_linked_updated(spark):
    u = "https://jobs.example.test/a"
    rows = [posting(0, "a", "1", u), posting(1, "a", "1", u), posting(2, "b", "x", u), posting(3, "a", "1", u, title="Senior Engineer")]
    outcomes, after = U.upsert(spark.createDataFrame(rows, KIND), U.empty_store(spark.createDataFrame(rows, KIND)))
    got = [(r.outcome, r.revision_number, r.job_id) for r in outcomes.orderBy("position").collect()]
    assert got == [("CREATED", None, "new 0"), ("UNCHANGED", None, "new 0"), ("LINKED_TO_EXISTING", None, "new 0"), ("UPDATED", 1, "new 0")]
    job = after.jobs.first()
    assert (job.title, job.first_seen_at, job.last_seen_at) == ("Senior Engineer", rows[0][7], rows[3][7])
    assert (after.references.count(), after.revisions.count(), after.fingerprints.count()) == (2, 1, 1)
    assert [(r.from_status, r.to_status) for r in after.history.collect()] == [(None, "NEW")]
    assert after.revisions.first().snapshot == '{"title":{"before":"Engineer","after":"Senior Engineer"}}'


@pytest.mark.parametrize("seed", [1])
def test_against_a_sequential_model(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(24):
        n = rng.randrange(12)
        url = f"https://jobs.example.test/{rng.choice([n, n, n, rng.randrange(12)])}"
        rows.append(posting(k, rng.choice("ab"), str(n), url, rng.choice(["Engineer", "Analyst"]), None, rng.choice([None, None, f"p {n % 5}"]), f"2026-07-29T10:{rng.randrange(60):02d}:00.000Z", rng.choice([None, "text"])))
    jobs, refs, revisions, out = model(rows)
    frame = spark.createDataFrame(rows, KIND)
    first, second = frame.where("position < 15"), frame.where("position >= 15")  # a store that is there already
    a, state = U.upsert(first, U.empty_store(frame))
    b, state = U.upsert(second, state)
    got = {r.position: (r.job_id, r.outcome, r.revision_number) for r in a.unionByName(b).collect()}
    assert got == out
    assert {r.id: (r.title, r.description, r.canonical_url, r.first_seen_at, r.last_seen_at) for r in state.jobs.collect()} == {k: (j["title"], j["description"], j["canonical_url"], j["first"], j["last"]) for k, j in jobs.items()}
    assert sorted((r.source_id, r.external_id, r.source_url, r.job_id, r.last_seen_at) for r in state.references.collect()) == sorted((r["s"], r["e"], r["u"], r["job"], r["last"]) for r in refs)
    assert sorted((r.job_id, r.revision_number, tuple(r.changed_fields)) for r in state.revisions.collect()) == sorted(revisions)


def test_one_identity_many_times_costs_as_few_jobs(spark):
    """Plain postings are written at once: 400 of one identity take no more jobs than 4."""
    tracker = spark.sparkContext.statusTracker()

    def jobs_of(n):
        rows = [posting(k, "a", "1", "https://jobs.example.test/a", title=f"T{k // 3}", description=None if k % 5 else f"d{k // 10}", at=f"2026-07-29T{10 + k % 9}:00:00.000Z") for k in range(n)]
        frame = spark.createDataFrame(rows, KIND)
        spark.sparkContext.setJobGroup(f"upsert {n}", "")
        outcomes, after = U.upsert(frame, U.empty_store(frame))
        spark.sparkContext.setJobGroup("", "")
        jobs, _, revisions, out = model(rows)
        assert {r.position: (r.job_id, r.outcome, r.revision_number) for r in outcomes.collect()} == out
        assert [(r.title, r.description, r.first_seen_at, r.last_seen_at) for r in after.jobs.collect()] == [(j["title"], j["description"], j["first"], j["last"]) for j in jobs.values()]
        assert after.revisions.count() == len(revisions) and after.references.count() == after.fingerprints.count() == 1
        return len(tracker.getJobIdsForGroup(f"upsert {n}"))

    assert jobs_of(400) <= jobs_of(4) + 2


def test_plain_postings_of_a_stored_one(spark):
    """Of a stored posting by external id: another canonical URL, another source, another title."""
    rows = [posting(0, "a", "1", "https://x.test/1"), posting(1, "b", "9", "https://x.test/9"), posting(2, "a", "1", "https://x.test/2", canonical="https://x.test/2"), posting(3, "a", "1", "https://x.test/2", title="New"), posting(4, "b", "9", "https://x.test/9", description="d")]
    frame = spark.createDataFrame(rows, KIND)
    a, state = U.upsert(frame.where("position < 2"), U.empty_store(frame))
    b, state = U.upsert(frame.where("position >= 2"), state)
    jobs, refs, revisions, out = model(rows)
    assert {r.position: (r.job_id, r.outcome, r.revision_number) for r in a.unionByName(b).collect()} == out
    assert {r.id: (r.title, r.description, r.canonical_url) for r in state.jobs.collect()} == {k: (j["title"], j["description"], j["canonical_url"]) for k, j in jobs.items()}
    assert sorted((r.source_id, r.external_id, r.last_seen_at) for r in state.references.collect()) == sorted((r["s"], r["e"], r["last"]) for r in refs)


def test_lists_objects_and_json_compare_by_value(spark):
    kind = "k int, old struct<title:string,locations:array<struct<country:string,city:string>>,skills:map<string,int>,metadata:string,description:string>, new struct<title:string,locations:array<struct<country:string,city:string>>,skills:map<string,int>,metadata:string,description:string>"
    base = ("T", [("IT", "Rome")], {"a": 1, "b": 2}, '{"a": {"x": 1, "y": [1, 2]}, "b": 2.0}', '{"a":1}')
    rows = [
        (0, base, ("T", [("IT", "Rome")], {"b": 2, "a": 1}, '{"b":2,"a":{"y":[1,2],"x":1.00}}', '{"a":1}')), (1, base, ("T", [("IT", "Bern")], {"a": 1}, '{"a": {"x": 1, "y": [2, 1]}, "b": 2}', '{"a": 1}')),
        (2, base, (None,) * 5), (3, (None,) * 5, base), (4, ("T", None, None, "not json", None), ("T", None, None, "not  json", None)),
    ]
    df = spark.createDataFrame(rows, kind)
    fields = ["title", "locations", "skills", "metadata", "description"]
    kinds = S.kinds_of(df.select("old.*"))
    got = {r.k: (r.c, r.s) for r in df.select("k", S.changed_fields(fields, kinds=kinds).alias("c"), S.revision_snapshot(fields, kinds=kinds).alias("s")).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: [], 1: ["locations", "skills", "metadata", "description"], 2: [], 3: fields, 4: ["metadata"]}
    said = json.loads(got[1][1])
    assert said["locations"] == {"before": [{"country": "IT", "city": "Rome"}], "after": [{"country": "IT", "city": "Bern"}]} and said["skills"]["after"] == {"a": 1} and said["metadata"]["before"] == {"a": {"x": 1, "y": [1, 2]}, "b": 2}
    assert json.loads(got[4][1]) == {"metadata": {"before": "not json", "after": "not  json"}} and json.loads(got[3][1])["title"] == {"before": None, "after": "T"}


def test_runs(spark):
    counts = spark.createDataFrame([("a", 5, 1), ("b", 2, 0), ("c", 9, 9)], "source_id string, raw_job_count long, invalid_job_count long")
    outcomes = spark.createDataFrame([("a", "CREATED"), ("a", "UPDATED"), ("a", "JOB_IDENTITY_CONFLICT"), ("b", "LINKED_TO_EXISTING"), ("b", "UNCHANGED")], "source_id string, outcome string")
    failures = spark.createDataFrame([("c", "HTTP_TIMEOUT", "late"), ("d", "COLLECTION_ABORTED", "stopped")], "source_id string, code string, message string")
    results = U.source_results(counts, outcomes, failures)
    assert {r.source_id: (r.status, r.raw_jobs_found, r.failure_code) for r in results.collect()} == {"a": ("PARTIALLY_FAILED", 5, "JOB_PERSISTENCE_FAILED"), "b": ("SUCCEEDED", 2, None), "c": ("FAILED", 0, "HTTP_TIMEOUT"), "d": ("CANCELLED", 0, "COLLECTION_ABORTED")}
    assert {r.source_id: r.status for r in U.stored_results(results, "r").collect()} == {"a": "PARTIALLY_FAILED", "b": "COMPLETED", "c": "FAILED", "d": "SKIPPED"}
    run = U.run_summary(results, "r", "t0", "t1").first()
    assert (run.status, run.attempted_source_count, run.succeeded_source_count, run.failed_source_count, run.duplicate_count, run.failed_count) == ("PARTIALLY_FAILED", 4, 2, 1, 2, 2)
    assert U.run_summary(results.limit(0), "r", "t0", "t1").first().status == "FAILED" and U.run_summary(results, "r", "t0", "t1", cancelled=True).first().status == "CANCELLED"
    stored = U.stored_results(results, "r")
    assert U.upsert_results(stored, stored.where("source_id = 'a'")).count() == 4


def test_scores_and_recommendations(spark):
    jobs = spark.createDataFrame([("j",)], "id string")
    scores = spark.createDataFrame([("s", "j", [("b", 1.0), ("a", 2.0)]), ("t", "k", [])], "id string, job_id string, components array<struct<key:string,raw:double>>")
    good, bad = U.save_scores(scores, jobs)
    assert [c.key for c in good.first().components] == ["a", "b"] and bad.first().id == "t"
    said = spark.createDataFrame([("s", "j", 2, "x", "1"), ("s", "k", 1, "x", "1"), ("s", "j", 1, "x", "2")], "score_id string, job_id string, rank int, recommendation_batch string, created_at string")
    good, bad = U.save_recommendations(said, scores)
    assert [r.rank for r in U.recommendation_batch(good, "x").collect()] == [1, 2] and bad.count() == 1
