import pytest
from pyspark.sql import functions as F

from hireloom.functions.text import clean, comparison_key, company_key, company_key_of, decode_entities, html_to_text, key_of
from hireloom.functions.urls import normalize_url
from hireloom.operators.normalize import HardFilterConfig, normalize

from .model import SCHEMA, job

CONFIG = HardFilterConfig(removable_tracking_parameters=["utm_source"], company_legal_suffixes=["GmbH", "Ltd."])


def one(spark, **changes):
    return normalize(spark.createDataFrame([job(1, **changes)], SCHEMA), CONFIG).first()


def values(spark, f, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.v for r in df.select("k", f(F.col("t")).alias("v")).orderBy("k").collect()]


def test_golden_cases(spark):
    cases = [
        ({"title": "Junior Data Scientist", "metadata": {"locationText": "Remote within the EU"}, "remote_policy": "remote"}, lambda r: (r.normalized_title, r.seniority, r.remote_scope) == ("Data Scientist", "entry", "EU")),
        ({"title": "Senior Data Scientist", "metadata": {"locationText": "Remote - US only"}, "remote_policy": "remote"}, lambda r: (r.seniority, r.country_code, r.remote_scope) == ("senior", "US", "COUNTRY")),
        ({"description": "German C1 proficiency is required."}, lambda r: [(x.code, x.proficiency, x.requirement) for x in r.language_requirements] == [("de", "professional", "REQUIRED")]),
        ({"description": "Candidates must have a PhD degree."}, lambda r: [(x.level, x.requirement) for x in r.education_requirements] == [("doctorate", "REQUIRED")]),
        ({"metadata": {"locationText": "Remote"}, "remote_policy": "remote"}, lambda r: r.remote_scope == "UNSPECIFIED" and [i.code for i in r.issues] == ["AMBIGUOUS_LOCATION"]),
        ({"metadata": {"locationText": "Hybrid - Milan"}}, lambda r: r.normalized_policy == "hybrid"),
        ({"title": "Software Engineering Internship"}, lambda r: r.seniority == "intern"),
        ({"metadata": {"salaryText": "EUR 500-700 per day gross"}}, lambda r: (r.salary.minimum_amount, r.salary.maximum_amount, r.salary.period, r.salary.gross_net) == (500, 700, "DAY", "GROSS")),
        ({"application_url": "https://apply.example.test/jobs/one?utm_source=x"}, lambda r: r.identity_url == "https://apply.example.test/jobs/one"),
        ({"metadata": {"salaryText": "Competitive plus many benefits"}}, lambda r: r.salary.parsing_status == "UNPARSEABLE" and "UNPARSEABLE_SALARY" in [i.code for i in r.issues]),
        ({"title": " "}, lambda r: not r.valid and [(i.code, i.field) for i in r.issues] == [("MISSING_REQUIRED_FIELD", "title")]),
        ({"application_url": "ftp://x/y"}, lambda r: not r.valid and r.issues[0].code == "INVALID_APPLICATION_URL"),
        # quirks: gate words that end inside a word, degree with a stop, seniority before a comma
        ({"description": "Fluent German. Proficient in German. A Ph.D. is required."}, lambda r: r.language_requirements == [] and r.education_requirements == []),
        ({"title": "Senior, Engineer"}, lambda r: r.seniority is None),
        ({"title": "Sr. Engineer"}, lambda r: r.normalized_title == ". Engineer"),
        ({"metadata": {"salaryText": "70,000 EUR"}}, lambda r: r.salary.parsing_status == "UNPARSEABLE"),
        ({"locations": [{"country": "UK", "city": None, "region": None}]}, lambda r: r.country_codes == ["UK", "GB"]),
        ({"description": "Python, R&D and postgres."}, lambda r: [s.canonical_name for s in r.skill_requirements] == ["PostgreSQL", "Python", "R"]),
    ]
    rows = normalize(spark.createDataFrame([job(k, **c) for k, (c, _) in enumerate(cases)], SCHEMA), CONFIG).orderBy("id").collect()
    assert [k for k, (row, (_, holds)) in enumerate(zip(rows, cases, strict=True)) if not holds(row)] == []


def test_experience(spark):
    r = one(spark, description="Up to 2 years of experience preferred. At least 3-5 years of relevant experience required! 10+ years experience")
    assert [(x.minimum_years, x.maximum_years, x.level) for x in r.experience_requirements] == [(0, 2, "PREFERRED"), (3, 5, "REQUIRED"), (10, None, "UNKNOWN")]


def test_authorization(spark):
    r = one(spark, description="Must be authorized to work in Germany. EU citizens only.\nNo sponsorship; security clearance is required.")
    got = [(x.country_code, x.country_group, x.sponsorship_available, x.citizenship_only, x.security_clearance_required) for x in r.work_authorization_requirements]
    assert got == [("DE", None, None, False, False), (None, "EU", None, True, False), (None, None, False, False, True)]


def test_keys(spark):
    texts = ["  Ｅxample  Labs, GmbH ", "Blue & Green", None, "", "GmbH"]
    assert values(spark, clean, texts) == ["Example Labs, GmbH", "Blue & Green", None, "", "GmbH"]
    assert values(spark, comparison_key, texts) == ["example labs gmbh", "blue green", None, "", "gmbh"]
    assert values(spark, lambda c: company_key(c, ["GmbH"]), texts) == ["example labs", "blue green", None, "", "gmbh"]
    assert [key_of(t) for t in texts if t is not None] == ["example labs gmbh", "blue green", "", "gmbh"]
    assert company_key_of("Example Labs GmbH", ["GmbH"]) == "example labs"


@pytest.mark.parametrize(("url", "value", "code"), [
    ("https://Jobs.Example.test:443/a/../b//?b=2&utm_source=x&a=1#top", "https://jobs.example.test/b?a=1&b=2", None),
    ("https://x.test", "https://x.test/", None), ("http://localhost:8080/a/", "http://localhost:8080/a", None),
    ("http://x.test/", None, "HTTPS_REQUIRED"), ("https://u:p@x.test/", None, "CREDENTIALS_NOT_ALLOWED"), ("nonsense", None, "INVALID_URL"), (None, None, "INVALID_URL"),
    ("https://x.test/?q=a%20b", "https://x.test/?q=a+b", None),
])
def test_urls(spark, url, value, code):
    r = values(spark, lambda c: normalize_url(c, ["utm_source"], strip_slash=True, sort=True), [url])[0]
    assert (r.value, r.code) == (value, code)


def test_html(spark):
    html = "<p>One &amp; two</p><script>x()</script><div>&#233;&#x1F600;&nope;&#99999999;</div><br/>&lt;b&gt;"
    assert values(spark, html_to_text, [html, "<br>", None, ""]) == ["One & two\né\U0001f600\n<b>", None, None, None]
    assert values(spark, decode_entities, ["a&LT;b&nbsp;c"]) == ["a<b c"]
