"""Rules of stored rows, and postings of their own error beside others."""

import pytest
from pyspark.sql import functions as F

from hireloom.operators.filters import Candidate
from hireloom.operators.mapping import CODE, JOB_RULES, SCORE_RULES, broken_rule, mapped
from hireloom.operators.normalize import HardFilterConfig
from hireloom.operators.process import ERROR_MESSAGE, decide, derived, process, summary

from .model import SCHEMA, job

NOW = "2026-07-29T12:00:00.000Z"


@pytest.mark.parametrize(
    ("kind", "values", "bad"),
    [
        ("current_status string", ["NEW", "EXPIRED"], ["new", "GONE", "", None]),
        ("remote_policy string", ["remote", None], ["Remote", ""]),
        ("locations string", ["[]", '[{"country":"IT","x":[1]}]', None], ["{}", "x", '[{"country":null}]', '[{"country":1}]', '["IT"]', "[null]"]),
        ("locations array<struct<country:string,city:string>>", [[], [("IT", None)], None], [[(None, "Rome")], [("IT", None), (None, None)], [None]]),
        ("normalized_skills string", ["[]", '["a"]', None], ['["a",null]', "[1]", '"a"', "{}"]),
        ("normalized_skills array<string>", [[], ["a"], None], [[None]]),
        ("salary_minimum double", [0.0, -1.5, None], [float("nan"), float("inf"), float("-inf")]),
        ("salary_maximum string", ["1", "1.5", None], ["NaN", "x", "1e999", ""]),
        ("expires_at string", [NOW, "2026-01-02", None], ["soon", "2026-13-01", ""]),
        ("metadata string", ["{}", "[1]", "1", None], ["{", "x y", ""]),
    ],
)
def test_rules(spark, kind, values, bad):
    field = kind.split()[0]
    df = spark.createDataFrame([(k, v, "x", "y") for k, v in enumerate(values + bad)], f"k int, {kind}, code string, message string").drop("code", "message")
    good, wrong = mapped(df)
    assert sorted(r.k for r in good.collect()) == list(range(len(values))) and good.columns == df.columns
    assert sorted((r.k, r.code, r.field) for r in wrong.collect()) == [(k, CODE, field) for k in range(len(values), len(values + bad))]
    assert {r.message for r in wrong.collect()} <= {r.message for r in JOB_RULES if r.field == field}


def test_the_first_broken_rule_counts_and_fields_may_lack(spark):
    df = spark.createDataFrame([("j", "GONE", "x"), (None, "NEW", "remote"), ("j", "NEW", "remote")], "id string, current_status string, remote_policy string")
    assert [r.b and r.b.field for r in df.select(broken_rule(df).alias("b")).collect()] == ["current_status", "id", None]
    none = spark.createDataFrame([(1,)], "other int")
    assert mapped(none)[0].count() == 1 and mapped(none)[1].count() == 0
    scores = spark.createDataFrame([("j", 1.0), ("j", None), (None, 1.0)], "job_id string, total double")
    assert [r.field for r in mapped(scores, SCORE_RULES)[1].orderBy("field").collect()] == ["job_id", "total"]


def test_one_bad_posting_is_an_error_and_the_rest_is_decided(spark):
    jobs = spark.createDataFrame([job(1), job(2, remote_policy="anywhere"), job(3, title=" "), job(4, title="Other", expires_at="never")], SCHEMA)
    who, config = Candidate(), HardFilterConfig()
    made = decide(jobs, who, config, NOW).cache()
    got = {r.job_id: r for r in made.collect()}
    assert {k: r.processing_status for k, r in got.items()} == {"0001": "ELIGIBLE", "0002": "ERROR", "0003": "NORMALIZATION_FAILED", "0004": "ERROR"}
    assert (got["0002"].error_code, got["0002"].error_field, got["0002"].error_message) == (CODE, "remote_policy", ERROR_MESSAGE) and got["0004"].error_field == "expires_at"
    assert got["0001"].error_code is None and got["0002"].reasons is None and got["0002"].config_fingerprint == got["0001"].config_fingerprint
    row = summary(jobs, made).first()
    assert (row.status, row.error_count, row.normalized_count, row.normalization_failed_count, row.eligible_count, row.skipped_count) == ("PARTIALLY_FAILED", 2, 1, 1, 1, 0)
    assert summary(jobs.where("id = '0002'"), made.where("job_id = '0002'")).first().status == "FAILED"
    assert derived(made).select("job_id").collect()[0].job_id == "0001" and derived(made).count() == 1
    again = process(jobs, made, who, config, NOW)  # an error is a decision: it is not taken up again
    assert again.count() == 0
    made.unpersist()


def test_an_error_is_nobodys_duplicate(spark):
    jobs = spark.createDataFrame([job(1, remote_policy="anywhere"), job(2), job(3)], SCHEMA)
    got = {r.job_id: (r.processing_status, r.candidate_job_ids) for r in decide(jobs, Candidate(), HardFilterConfig(), NOW).collect()}
    assert got["0002"][0] == "ELIGIBLE" and got["0003"] == ("POSSIBLE_DUPLICATE", ["0002"])
    assert decide(jobs.where(F.lit(False)), Candidate(), HardFilterConfig(), NOW).count() == 0
