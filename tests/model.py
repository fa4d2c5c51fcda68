"""Input rows for tests, and a sequential model of the greedy scan."""

import json

SCHEMA = (
    "id string,source_id string,external_id string,source_url string,canonical_url string,application_url string,title string,company string,description string,"
    "locations array<struct<country:string,city:string,region:string>>,remote_policy string,employment_type string,salary_minimum double,salary_maximum double,"
    "salary_currency string,salary_period string,published_at string,expires_at string,first_seen_at string,last_collected_at string,metadata string,input_revision_number int"
)


def job(i: int, **changes) -> dict:
    row = dict.fromkeys(c.split(" ")[0].split(":")[0] for c in SCHEMA.replace("array<struct<country:string,city:string,region:string>>", "array").split(","))
    row |= {
        "id": f"{i:04d}", "source_id": "source-a", "external_id": f"job-{i}", "source_url": "https://jobs.example.test/one", "canonical_url": f"https://jobs.example.test/{i}", "title": "Data Engineer", "company": "Example Labs",
        "locations": [], "first_seen_at": "2026-07-28T12:00:00Z", "last_collected_at": "2026-07-29T10:00:00Z", "input_revision_number": 0,
    }
    row |= {k: json.dumps(v) if k == "metadata" else v for k, v in changes.items()}
    return row


def greedy(rows: list[tuple]) -> dict:
    """rows (ord, keys by layer) in any order: ord to (layer, primary) of duplicates."""
    seen: list[dict] = [{}, {}, {}]
    out = {}
    for ord_, keys in sorted(rows):
        hit = next(((k, seen[k][key]) for k, key in enumerate(keys) if key is not None and key in seen[k]), None)
        if hit:
            out[ord_] = hit
            continue
        for k, key in enumerate(keys):
            if key is not None:
                seen[k][key] = ord_
    return out
