import random

import pytest
from pyspark.sql import functions as F

from hireloom.operators.dedup import LAYERS, classify, retained, with_fingerprint
from hireloom.operators.filters import Candidate, hard_filters
from hireloom.operators.normalize import HardFilterConfig, normalize
from hireloom.operators.process import check_limit, config_fingerprint, decide, process, summary

from .model import SCHEMA, greedy, job

NOW = "2026-07-29T12:00:00.000Z"
STRICT = HardFilterConfig(
    allowed_countries=["IT"], reject_unknown_location=True, allow_mandatory_phd=False, reject_unknown_industry=True, unknown_candidate_language_level_policy="reject", maximum_seniority="entry",
    maximum_required_experience_years=2, excluded_companies=["Example Labs"], excluded_title_phrases=["data engineer"],
)


def test_all_ten_reasons_in_order(spark):
    text = "Must be authorized to work in Germany. German C1 is required. 5 years of experience required. PhD degree required."
    row = job(1, title="Senior Data Engineer", company="example labs", description=text, metadata={"locationText": "Berlin, Germany"}, expires_at=NOW)
    got = hard_filters(normalize(spark.createDataFrame([row], SCHEMA), STRICT), Candidate(), STRICT, NOW).first()
    assert [r.code for r in got.reasons] == [
        "COUNTRY_NOT_ALLOWED", "WORK_AUTHORIZATION_NOT_AVAILABLE", "MISSING_REQUIRED_LANGUAGE", "SENIORITY_EXCEEDS_MAXIMUM", "EXPERIENCE_EXCEEDS_MAXIMUM", "PHD_REQUIRED", "EXCLUDED_COMPANY", "EXCLUDED_INDUSTRY", "EXCLUDED_TITLE_PATTERN", "JOB_EXPIRED",
    ]
    assert got.filter_decision == "REJECTED"


def test_greedy_scan_equals_sequential_model(spark):
    rng = random.Random(5)
    rows = []
    for n in range(300):
        keys = [str(rng.randrange(90)) if rng.random() < 0.8 else None, str(rng.randrange(150)), str(rng.randrange(200)) if rng.random() < 0.5 else None]
        rows.append((("t", f"{n:04d}"), keys))
    want = greedy(rows)
    data = [(ord_, layer, key) for ord_, keys in rows for layer, key in enumerate(keys) if key is not None]
    keys = spark.createDataFrame(data, "ord struct<seen:string,id:string>, layer int, key string")
    kept = {tuple(r.ord) for r in retained(keys).collect()}
    assert kept == {o for o, _ in rows} - set(want)


def test_duplicates_register_no_keys(spark):
    rows = [job(1, external_id="e1", canonical_url="https://x.test/1"), job(2, external_id="e2", canonical_url="https://x.test/1"), job(3, external_id="e2", canonical_url="https://x.test/3", title="Other")]
    got = {r.id: (r.duplicate_decision, r.primary_job_id, r.duplicate_layer) for r in classify(with_fingerprint(normalize(spark.createDataFrame(rows, SCHEMA), HardFilterConfig()))).collect()}
    assert got == {"0001": ("UNIQUE", None, None), "0002": ("DUPLICATE", "0001", LAYERS[1]), "0003": ("UNIQUE", None, None)}


def test_many_equal_postings_have_twenty_candidates(spark):
    rows = [job(i) for i in range(60)]
    got = decide(spark.createDataFrame(rows, SCHEMA), Candidate(), HardFilterConfig(), NOW).orderBy("job_id").collect()
    assert [r.processing_status for r in got] == ["ELIGIBLE"] + ["POSSIBLE_DUPLICATE"] * 59
    assert got[59].candidate_job_ids == [f"{i:04d}" for i in range(20)] and got[3].candidate_job_ids == ["0000", "0001", "0002"]


def test_rerun_and_revision(spark):
    jobs = spark.createDataFrame([job(1), job(2, title=" "), job(3, canonical_url="https://jobs.example.test/1")], SCHEMA)
    config, who = HardFilterConfig(), Candidate()
    empty = decide(jobs, who, config, NOW).limit(0)
    first = process(jobs, empty, who, config, NOW).cache()
    assert {r.job_id: r.processing_status for r in first.collect()} == {"0001": "ELIGIBLE", "0002": "NORMALIZATION_FAILED", "0003": "DUPLICATE"}
    assert process(jobs, first, who, config, NOW).count() == 0
    newer = jobs.withColumn("input_revision_number", F.when(F.col("id") == "0001", 1).otherwise(0))
    assert [r.job_id for r in process(newer, first, who, config, NOW).collect()] == ["0001"]
    assert process(jobs, first, who, HardFilterConfig(maximum_seniority="mid"), NOW).count() == 3
    s = summary(jobs, first).first()
    assert (s.considered_count, s.normalized_count, s.normalization_failed_count, s.duplicate_count, s.eligible_count, s.skipped_count, s.status) == (3, 2, 1, 1, 1, 0, "COMPLETED")


def test_config_fingerprint_ignores_order():
    a, b = HardFilterConfig(excluded_companies=["a", "b"]), HardFilterConfig(excluded_companies=["b", "a"])
    assert config_fingerprint(Candidate(), a) == config_fingerprint(Candidate(), b) != config_fingerprint(Candidate(), HardFilterConfig())


@pytest.mark.parametrize("limit", [0, 10_001, 1.5, True])
def test_limit(limit):
    with pytest.raises(ValueError):
        check_limit(limit)


def test_derived_columns(spark):
    from hireloom.operators.process import current, derived

    jobs = spark.createDataFrame([job(1, description="Candidates must have a PhD degree. Python and SQL required."), job(2, title=" ")], SCHEMA)
    one = derived(decide(jobs, Candidate(), HardFilterConfig(), NOW))
    later = one.withColumns({"processed_at": F.lit("2026-07-30T12:00:00.000Z"), "seniority": F.lit("lead")})
    (r,) = current(one.unionByName(later)).collect()
    assert (r.job_id, r.required_education, r.normalized_skills, r.required_experience, r.seniority) == ("0001", "doctorate", ["Python", "SQL"], None, "lead")


def test_postings_are_normalized_once(spark, tmp_path):
    """Classifying and filtering read what normalize() made, and do not make it again (F6)."""
    from hireloom.plans.queries import CANDIDATE, CONFIG, NOW
    from hireloom.plans.postings import postings

    spark.createDataFrame([(i, "web", "en") for i in range(20)], "doc_id long, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = spark.sparkContext.accumulator(0)
    spark.udf.register("seen_once", lambda x: (seen.add(1), x)[1], "string")
    jobs = postings(spark, str(tmp_path)).withColumn("title", F.expr("seen_once(title)"))
    made = decide(jobs, CANDIDATE, CONFIG, NOW)
    before = seen.value
    assert made.count() == 20
    assert made.where("processing_status = 'ELIGIBLE' OR processing_status <> 'ELIGIBLE'").count() == 20
    assert before > 0 and seen.value == before
