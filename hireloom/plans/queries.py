"""Queries over the driver's tables, with SQL that says the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, company_key, comparison_key, html_to_text
from ..functions.urls import normalize_url
from ..operators import store, upsert
from ..operators import vocabulary as V
from ..operators.dedup import classify, with_fingerprint
from ..operators.filters import Candidate, hard_filters
from ..operators.normalize import HardFilterConfig, normalize
from ..operators.process import decide, first_references, pending, processable, summary
from .postings import POSTINGS_SQL, SUFFIXES, postings

CONFIG = HardFilterConfig(
    allowed_countries=["DE", "IT"], allowed_country_groups=["EEA"], reject_unknown_location=False, allow_mandatory_phd=False, unknown_candidate_language_level_policy="reject", maximum_seniority="senior",
    maximum_required_experience_years=5, excluded_companies=["Northwind"], excluded_industries=["es"], excluded_title_phrases=["office manager", "support"], removable_tracking_parameters=["utm_source"],
    company_legal_suffixes=SUFFIXES,
)
CANDIDATE = Candidate(education_levels=["master"], languages={"en": "fluent", "de": "conversational"}, citizenships=["IT"], work_authorizations=[("GB", "sponsorship-required")])
NOW = "2026-07-29T12:00:00.000Z"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(postings(spark, sf_dir), CONFIG)


def _key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _company(x: str) -> str:
    out = _key(x)
    for s in SUFFIXES:
        out = f"regexp_replace({out}, ' {s}$', '')"
    return out


_SENIORITY = "CASE WHEN regexp_matches(title, '(?i)" + V.SENIORITY_EXCLUDED + "') THEN NULL " + " ".join(f"WHEN regexp_matches(title, '(?i){p.replace('(?=' + chr(92) + 's|$)', '(' + chr(92) + 's|$)')}') THEN '{k}'" for k, p, _ in V.SENIORITY_RULES) + " END"
_BARE = "CASE level " + " ".join(f"WHEN '{k}' THEN regexp_replace(title, '(?i){(r or p)}', ' ', 'g')" for k, p, r in V.SENIORITY_RULES if k != "lead") + " WHEN 'lead' THEN regexp_replace(regexp_replace(title, '(?i)\\b(team|technical|engineering|data|product) lead\\b', ' ', 'g'), '(?i)\\blead(\\s+(engineer|developer|scientist|architect))', ' \\1', 'g') ELSE title END"
_TITLES = f"p AS ({POSTINGS_SQL}), s AS (SELECT *, {_SENIORITY} AS level FROM p), t AS (SELECT *, CASE WHEN level IS NULL THEN title ELSE trim(regexp_replace(regexp_replace({_BARE}, '^[-,:\\s]+|[-,:\\s]+$', '', 'g'), '\\s+', ' ', 'g')) END AS bare FROM s)"


@query(f"WITH p AS ({POSTINGS_SQL}) SELECT doc_id, {_key('title')} AS title_key, {_company('company')} AS company_key FROM p")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM06-08: cleaning, comparison and company keys."""
    p = postings(spark, sf_dir)
    return p.select(F.col("id").cast("long").alias("doc_id"), comparison_key(F.col("title")).alias("title_key"), company_key(F.col("company"), SUFFIXES).alias("company_key"))


@query(f"WITH {_TITLES} SELECT doc_id, level AS seniority, bare AS normalized_title, {_key('bare')} AS title_key FROM t")
def title_seniority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM09, NRM10: seniority by the first rule, and titles without it."""
    n = _normalized(spark, sf_dir)
    return n.select(F.col("id").cast("long").alias("doc_id"), "seniority", "normalized_title", "title_key")


_ALIAS = " ".join(f"WHEN regexp_matches(lower(place), '(^|[^a-z]){k}($|[^a-z])') THEN '{v}'" for k, v in V.COUNTRIES.items())
_KNOWN = ", ".join(f"'{c}'" for c in sorted(set(V.COUNTRIES.values())))
_PLACES = f"""p AS ({POSTINGS_SQL}), c AS (SELECT *, CASE WHEN regexp_extract(place, '\\b[A-Z]{{2}}\\b') IN ({_KNOWN}) THEN regexp_extract(place, '\\b[A-Z]{{2}}\\b') ELSE CASE {_ALIAS} END END AS country,
  coalesce(remote_policy, CASE WHEN regexp_matches(place, '(?i)\\bhybrid\\b') THEN 'hybrid' WHEN regexp_matches(place, '(?i)\\bremote\\b') THEN 'remote' END, 'unspecified') AS policy FROM p),
 l AS (SELECT *, CASE WHEN policy <> 'remote' THEN 'UNSPECIFIED' WHEN regexp_matches(place, '(?i)\\bworldwide|anywhere\\b') THEN 'WORLDWIDE' WHEN regexp_matches(place, '(?i)\\beea\\b') THEN 'EEA' WHEN regexp_matches(place, '(?i)\\beu(ropean union)?\\b') THEN 'EU'
  WHEN regexp_matches(place, '(?i)\\beurope\\b') THEN 'EUROPE' WHEN regexp_matches(place, '(?i)\\b(time ?zone|utc[+-])\\b') THEN 'TIMEZONE' WHEN country IS NULL THEN 'UNSPECIFIED' ELSE 'COUNTRY' END AS scope FROM c)"""


@query(f"WITH {_PLACES} SELECT doc_id, country AS country_code, policy AS remote_policy, scope AS remote_scope, policy || '|' || lower(scope) || '|' || {_key('place')} AS location_key FROM l")
def location_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM11-20: policy, countries, scope and key of a place."""
    n = _normalized(spark, sf_dir)
    return n.select(F.col("id").cast("long").alias("doc_id"), "country_code", F.col("normalized_policy").alias("remote_policy"), "remote_scope", "location_key")


def _amount(k: int) -> str:
    raw = f"regexp_extract(salary_text, '(?i)(?:\\b(EUR|USD|GBP)\\b|([€$£]))\\s*([\\d,.]+)(?:\\s*[–-]\\s*(?:\\b(?:EUR|USD|GBP)\\b|[€$£])?\\s*([\\d,.]+))?', {k})"
    return f"try_cast(regexp_replace(regexp_replace(regexp_replace({raw}, '[,.](\\d{{3}})$', '\\1'), '[,.](\\d{{3}}[,.])', '\\1', 'g'), ',', '.') AS DOUBLE)"


@query(f"""WITH p AS ({POSTINGS_SQL}), a AS (SELECT *, {_amount(3)} AS lo, {_amount(4)} AS hi FROM p)
SELECT doc_id, lo AS minimum_amount, CASE WHEN lo IS NOT NULL THEN hi END AS maximum_amount, CASE WHEN lo IS NULL THEN 'UNPARSEABLE' ELSE 'PARSED' END AS parsing_status,
 CASE WHEN lo IS NULL THEN 'UNSPECIFIED' {" ".join(f"WHEN regexp_matches(salary_text, '(?i){p}') THEN '{k}'" for k, p in V.PERIODS)} ELSE 'UNSPECIFIED' END AS period,
 CASE WHEN regexp_matches(salary_text, '(?i)\\bgross\\b') THEN 'GROSS' WHEN regexp_matches(salary_text, '(?i)\\bnet\\b') THEN 'NET' ELSE 'UNSPECIFIED' END AS gross_net FROM a""")
def salary_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM21-26: salaries from text."""
    return _normalized(spark, sf_dir).select(F.col("id").cast("long").alias("doc_id"), *(f"salary.{c}" for c in ("minimum_amount", "maximum_amount", "parsing_status", "period", "gross_net")))


@query(f"WITH p AS ({POSTINGS_SQL}) SELECT doc_id, " + ", ".join(f"regexp_matches(description, '(?i){p}') AS {name}" for name, p in (("postgresql", V.SKILLS[0][1]), ("python", V.SKILLS[4][1]), ("sql_skill", V.SKILLS[5][1]), ("typescript", V.SKILLS[2][1]))) + " FROM p")
def skill_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM32: skills of a description."""
    names = F.transform("skill_requirements", lambda x: x["canonical_name"])
    has = {"postgresql": "PostgreSQL", "python": "Python", "sql_skill": "SQL", "typescript": "TypeScript"}
    return _normalized(spark, sf_dir).select(F.col("id").cast("long").alias("doc_id"), *(F.array_contains(names, v).alias(k) for k, v in has.items()))


_SKILLED = ", ".join(f"CASE WHEN regexp_matches(description, '{'(?i)' + p if n != 'R' else '(^|[^A-Za-z0-9_])R($|[^A-Za-z0-9_])'}') THEN ['{n}'] ELSE [] END" for n, p, _ in V.SKILLS)


@query(f"WITH p AS ({POSTINGS_SQL}) SELECT doc_id, array_to_string(list_concat({_SKILLED}), ',') AS skills FROM p")
def all_skill_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM32: all skills of a description."""
    names = F.transform("skill_requirements", lambda x: x["canonical_name"])
    order = F.array(*(F.lit(n) for n, _, _ in V.SKILLS))
    return _normalized(spark, sf_dir).select(F.col("id").cast("long").alias("doc_id"), F.array_join(F.filter(order, lambda n: F.array_contains(names, n)), ",").alias("skills"))


@query(f"WITH p AS ({POSTINGS_SQL}) SELECT doc_id, identity_url FROM p")
def identity_url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM05: canonical URLs with their query: sorted, tracking parameters removed."""
    return _normalized(spark, sf_dir).select(F.col("id").cast("long").alias("doc_id"), "identity_url")


@query()
def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM27-34: experience, education, language and authorization requirements, and issues."""
    columns = ("experience_requirements", "education_requirements", "language_requirements", "skill_requirements", "work_authorization_requirements", "issues")
    return _normalized(spark, sf_dir).select("id", *(F.to_json(c).alias(c) for c in columns))


@query("""SELECT page_id, CASE WHEN starts_with(url, 'https://') AND NOT contains(url, '@') THEN lower(regexp_extract(url, '^(https://[^/?#]+)', 1)) || CASE WHEN regexp_extract(url, '^https://[^/?#]+([^?#]*)', 1) IN ('', '/') THEN '/' ELSE regexp_replace(regexp_extract(url, '^https://[^/?#]+([^?#]*)', 1), '/+$', '') END END AS base_url,
 CASE WHEN NOT starts_with(url, 'https://') THEN 'HTTPS_REQUIRED' WHEN contains(url, '@') THEN 'CREDENTIALS_NOT_ALLOWED' END AS code FROM pages""")
def identity_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM05, COL04: canonical URLs, here without their query."""
    u = normalize_url(F.col("url"), CONFIG.removable_tracking_parameters, strip_slash=True, sort=True)
    return _read(spark, sf_dir, "pages").select("page_id", u.alias("u")).select("page_id", F.substring_index("u.value", "?", 1).alias("base_url"), "u.code")


@query()
def html_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COL02, COL03: text of pages."""
    return _read(spark, sf_dir, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


@query("SELECT doc_id, sha256(lower(trim(source)) || chr(10) || lower(trim(lang)) || chr(10) || lower('HTTPS://x/' || doc_id::VARCHAR)) AS fingerprint FROM documents")
def identity_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COL12: the exact identity fingerprint."""
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", store.identity_fingerprint(F.col("source"), F.col("lang"), F.concat(F.lit("HTTPS://x/"), F.col("doc_id").cast("string"))).alias("fingerprint"))


@query(f"WITH p AS ({POSTINGS_SQL}) SELECT doc_id, min(doc_id) OVER (PARTITION BY identity_url) AS primary_id FROM p")
def dedup_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP03 alone: the first posting of each canonical URL."""
    n = _normalized(spark, sf_dir).select(F.col("id").cast("long").alias("doc_id"), "identity_url")
    first = n.groupBy("identity_url").agg(F.min("doc_id").alias("primary_id"))
    return n.join(first, "identity_url").select("doc_id", "primary_id")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(with_fingerprint(_normalized(spark, sf_dir)).where("valid"))


_GREEDY = f"""RECURSIVE {_TITLES}, k AS (
  SELECT row_number() OVER (ORDER BY t.id) AS n, t.id, t.doc_id, source_id || chr(1) || external_id AS k1, identity_url AS k2, c.location_key,
   concat_ws(chr(1), {_company('company')}, {_key('bare')}, c.location_key, coalesce(employment_type, ''), description) AS k3, concat_ws(chr(1), {_company('company')}, {_key('bare')}, c.location_key) AS k4
  FROM t JOIN (SELECT id, policy || '|' || lower(scope) || '|' || {_key('place')} AS location_key FROM (WITH {_PLACES} SELECT * FROM l)) c USING (id)),
g AS (
  SELECT 0::BIGINT AS n, ''::VARCHAR AS id, ''::VARCHAR AS decision, NULL::VARCHAR AS primary_id, MAP {{''::VARCHAR: ''::VARCHAR}} AS m1, MAP {{''::VARCHAR: ''::VARCHAR}} AS m2, MAP {{''::VARCHAR: ''::VARCHAR}} AS m3
  UNION ALL
  SELECT k.n, k.id, CASE WHEN coalesce(m1[k1], m2[k2], m3[k3]) IS NULL THEN 'KEPT' ELSE 'DUPLICATE' END, coalesce(m1[k1], m2[k2], m3[k3]),
   CASE WHEN coalesce(m1[k1], m2[k2], m3[k3]) IS NULL THEN map_concat(m1, MAP {{k1: k.id}}) ELSE m1 END, CASE WHEN coalesce(m1[k1], m2[k2], m3[k3]) IS NULL THEN map_concat(m2, MAP {{k2: k.id}}) ELSE m2 END, CASE WHEN coalesce(m1[k1], m2[k2], m3[k3]) IS NULL THEN map_concat(m3, MAP {{k3: k.id}}) ELSE m3 END
  FROM g JOIN k ON k.n = g.n + 1),
d AS (SELECT k.id, k.n, k4, decision, primary_id FROM k JOIN g USING (n)),
r AS (SELECT *, row_number() OVER (PARTITION BY k4 ORDER BY n) AS place FROM d WHERE decision = 'KEPT')"""


@query(f"WITH {_GREEDY} SELECT d.id, CASE WHEN d.decision = 'DUPLICATE' THEN 'DUPLICATE' WHEN r.place > 1 THEN 'POSSIBLE_DUPLICATE' ELSE 'UNIQUE' END AS decision, d.primary_id AS primary_job_id, CASE WHEN d.decision = 'KEPT' THEN least(r.place - 1, 20) ELSE 0 END AS candidates FROM d LEFT JOIN r USING (id)")
def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP01-11: the greedy scan over three strong layers and the review layer."""
    c = _classified(spark, sf_dir)
    return c.select("id", F.col("duplicate_decision").alias("decision"), "primary_job_id", F.coalesce(F.size("candidate_job_ids"), F.lit(0)).cast("long").alias("candidates"))


_EEA = ", ".join(f"'{c}'" for c in sorted({*V.EEA, "DE", "IT"}))
_ORDER = "list_position([" + ", ".join(f"'{s}'" for s in V.SENIORITY) + "], level)"


@query(f"""WITH {_TITLES}, f AS (SELECT t.*, c.country, c.scope FROM t JOIN (SELECT id, country, scope FROM (WITH {_PLACES} SELECT * FROM l)) c USING (id))
SELECT doc_id, NOT (scope IN ('WORLDWIDE', 'EU', 'EEA', 'EUROPE') OR country IS NULL OR country IN ({_EEA})) AS country, coalesce({_ORDER} > {V.SENIORITY.index("senior") + 1}, false) AS seniority,
 {_company('company')} = 'northwind' AS company, industry = 'es' AS industry, regexp_matches(' ' || {_key('title')} || ' ', ' (office manager|support) ') AS title, expired FROM f""")
def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT02-04, 07, 10-13: which simple filters reject a posting."""
    out = hard_filters(_normalized(spark, sf_dir), CANDIDATE, CONFIG, NOW)
    ids = F.transform("reasons", lambda r: r["filter_id"])
    names = {"country": "country", "seniority": "seniority", "company": "company", "industry": "industry", "title": "title", "expired": "expiration"}
    return out.select(F.col("id").cast("long").alias("doc_id"), *(F.array_contains(ids, v).alias(k) for k, v in names.items()))


#: What the description's sentences are rejected for; of authorizations, how many.
_SAID = {"experience": "contains(description, '10+ years')", "education": "contains(description, 'must have a PhD')", "language": "contains(description, 'German C1')", "work_authorization": " + ".join(f"(length(description) - length(replace(description, '{x}', ''))) // {len(x)}" for x in ("authorized to work", "No sponsorship"))}
_REASONS = f"""q AS (SELECT t.id, doc_id, NOT (scope IN ('WORLDWIDE', 'EU', 'EEA', 'EUROPE') OR country IS NULL OR country IN ({_EEA})) AS country, coalesce({_ORDER} > {V.SENIORITY.index("senior") + 1}, false) AS seniority,
 {_company("company")} = 'northwind' AS company, industry = 'es' AS industry, regexp_matches(' ' || {_key("title")} || ' ', ' (office manager|support) ') AS title, expired, {", ".join(f"({v}) AS {k}" for k, v in _SAID.items())}
 FROM t JOIN (SELECT id, country, scope FROM (WITH {_PLACES} SELECT * FROM l)) c USING (id))"""
_CODES = {
    "country": "COUNTRY_NOT_ALLOWED", "work_authorization": "WORK_AUTHORIZATION_NOT_AVAILABLE", "language": "MISSING_REQUIRED_LANGUAGE", "seniority": "SENIORITY_EXCEEDS_MAXIMUM", "experience": "EXPERIENCE_EXCEEDS_MAXIMUM",
    "education": "PHD_REQUIRED", "company": "EXCLUDED_COMPANY", "industry": "EXCLUDED_INDUSTRY", "title": "EXCLUDED_TITLE_PATTERN", "expired": "JOB_EXPIRED",
}
_LISTED = ", ".join(f"list_transform(range({k}::INT), lambda x: '{v}')" for k, v in _CODES.items())


@query(f"WITH {_TITLES}, {_REASONS} SELECT doc_id, array_to_string(list_concat({_LISTED}), ',') AS codes FROM q")
def all_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT01-15: every reason for which a posting is rejected, all ten filters, in their order."""
    out = hard_filters(_normalized(spark, sf_dir), CANDIDATE, CONFIG, NOW)
    return out.select(F.col("id").cast("long").alias("doc_id"), F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("codes"))


@query(" UNION ALL ".join(f"SELECT '{v}' AS code, sum({k}::INT)::BIGINT AS n FROM (WITH {_TITLES}, {_REASONS} SELECT * FROM q) HAVING sum({k}::INT) > 0" for k, v in _CODES.items()))
def filter_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT01-15: how often each filter rejects, all ten."""
    out = hard_filters(_normalized(spark, sf_dir), CANDIDATE, CONFIG, NOW)
    return out.select(F.explode("reasons").alias("r")).groupBy(F.col("r.code").alias("code")).agg(F.count("*").alias("n"))


@query(f"WITH {_TITLES} SELECT CASE WHEN coalesce({_ORDER} > 4, false) OR regexp_matches(' ' || {_key('title')} || ' ', ' (office manager|support) ') THEN 'REJECTED' ELSE 'ELIGIBLE' END AS decision, level AS seniority, count(*) AS n FROM t GROUP BY ALL")
def decisions_by_seniority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: seniority and title rules, decisions counted."""
    only = HardFilterConfig(maximum_seniority="senior", excluded_title_phrases=CONFIG.excluded_title_phrases, company_legal_suffixes=SUFFIXES)
    out = hard_filters(_normalized(spark, sf_dir), Candidate(), only, "2000-01-01T00:00:00Z")
    kept = F.filter("reasons", lambda r: r["filter_id"].isin("seniority", "title"))
    return out.groupBy(F.when(F.size(kept) > 0, "REJECTED").otherwise("ELIGIBLE").alias("decision"), "seniority").agg(F.count("*").alias("n"))


@query(f"""WITH {_GREEDY}, f AS (SELECT id, {" OR ".join(f"{k}::BOOLEAN" for k in _CODES)} AS rejected FROM (WITH {_TITLES}, {_REASONS} SELECT * FROM q)),
u AS (SELECT CASE WHEN d.decision = 'DUPLICATE' THEN 'DUPLICATE' WHEN f.rejected THEN 'REJECTED' WHEN r.place > 1 THEN 'POSSIBLE_DUPLICATE' ELSE 'ELIGIBLE' END AS status FROM d LEFT JOIN r ON r.id = d.id JOIN f ON f.id = d.id)
SELECT count(*) AS considered_count, 0::BIGINT AS normalization_failed_count, count_if(status = 'DUPLICATE')::BIGINT AS duplicate_count, count_if(status = 'POSSIBLE_DUPLICATE')::BIGINT AS possible_duplicate_count, count_if(status = 'REJECTED')::BIGINT AS rejected_count,
 count_if(status = 'ELIGIBLE')::BIGINT AS eligible_count, 0::BIGINT AS error_count, count(*) AS normalized_count, 0::BIGINT AS skipped_count, 'COMPLETED' AS status FROM u""")
def process_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRC01-12: a run over all postings, its counters and status."""
    jobs = postings(spark, sf_dir)
    return summary(jobs, decide(jobs, CANDIDATE, CONFIG, NOW))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRC03, PRC09: postings without a decision of these versions; labels stand for decisions, toxic ones for an older version's."""
    jobs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("input_revision_number"))
    made = _read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("job_id"), F.lit(0).alias("input_revision_number"), F.lit(V.NORMALIZATION_VERSION).alias("normalization_version"),
        F.lit(V.FINGERPRINT_VERSION).alias("fingerprint_version"), F.lit(V.FILTER_VERSION).alias("filter_rules_version"), F.lit("x").alias("config_fingerprint"),
    )
    return pending(jobs, made, "x").select(F.col("id").alias("doc_id"))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000")
def topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11, PRC01: the bounded batch, earliest first, with first references and latest revisions."""
    o = _read(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("last_collected_at"), F.lit("u").alias("canonical_url"))
    refs = o.select(F.col("o_orderkey").alias("job_id"), F.lit("s").alias("source_id"), F.col("o_custkey").cast("string").alias("external_id"), F.lit("u").alias("source_url"), F.col("o_orderdate").alias("first_seen_at"), F.col("o_orderkey").alias("id"))
    none = o.limit(0).select(F.col("o_orderkey").alias("job_id"), F.lit(1).alias("revision_number"))
    return processable(jobs, refs, none, 1000).select(F.col("id").alias("o_orderkey"), F.col("external_id").cast("long").alias("o_custkey"), F.col("last_collected_at").alias("o_orderdate"))


@query("SELECT conv_id, arg_min(role, turn) AS role, min(turn) AS turn FROM conversations GROUP BY conv_id")
def first_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11: each posting's first source reference."""
    c = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), F.col("role").alias("source_id"), F.col("turn").alias("external_id"), F.lit("u").alias("source_url"), F.col("turn").alias("first_seen_at"), F.col("turn").alias("id"))
    return first_references(c).select(F.col("job_id").alias("conv_id"), F.col("ref.source_id").alias("role"), F.col("ref.external_id").alias("turn"))


@query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR02: the latest row of each pair of keys."""
    return store.latest(_read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "ts")


@query("SELECT event_id, user_id, from_status, event_type FROM (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'NEW') AS from_status FROM events) WHERE from_status <> event_type")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPS13, UPS14: transitions, without updates to the same status."""
    return store.status_changes(_read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", F.lit("NEW")).select("event_id", "user_id", "from_status", "event_type")


_FIELDS = ["lang", "source", "n_chars"]
_CHANGED = "CASE WHEN b.lang IS NOT NULL AND a.lang IS DISTINCT FROM b.lang THEN 'lang' END, CASE WHEN b.source IS NOT NULL AND a.source IS DISTINCT FROM b.source THEN 'source' END, CASE WHEN b.n_chars IS NOT NULL AND a.n_chars IS DISTINCT FROM b.n_chars THEN 'n_chars' END"


@query(f"""WITH a AS (SELECT doc_id + 1 AS k, lang, source, n_chars FROM documents), b AS (SELECT doc_id AS k, nullif(lang, 'es') AS lang, source, n_chars FROM documents)
SELECT b.k, concat_ws(',', {_CHANGED}) AS changed FROM b JOIN a USING (k)""")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPS07: which fields of a row differ from what is stored, here the row before it; absence clears nothing."""
    d = _read(spark, sf_dir, "documents").select("doc_id", *_FIELDS)
    old = d.select((F.col("doc_id") + 1).alias("k"), F.struct(*_FIELDS).alias("old"))
    new = d.select(F.col("doc_id").alias("k"), F.struct(F.nullif("lang", F.lit("es")).alias("lang"), "source", "n_chars").alias("new"))
    return new.join(old, "k").select("k", F.array_join(store.changed_fields(_FIELDS), ",").alias("changed"))


@query("""WITH i AS (SELECT o_orderkey AS k, o_custkey % 700 AS c, o_orderkey % 900 AS u FROM orders), j AS (SELECT c_custkey AS id FROM customer)
SELECT i.k, CASE WHEN x.id IS NULL AND y.id IS NULL THEN 'CREATED' WHEN x.id <> y.id THEN 'JOB_IDENTITY_CONFLICT' ELSE 'FOUND' END AS identity FROM i LEFT JOIN j x ON x.id = i.c LEFT JOIN j y ON y.id = i.u""")
def identity_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPS03, UPS04: signals that find none, one or several stored postings."""
    none = F.lit(None).cast("string")
    i = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit("s").alias("source_id"), (F.col("o_custkey") % 700).alias("external_id"), none.alias("source_url"), (F.col("o_orderkey") % 900).alias("canonical_url"), none.alias("fingerprint"))
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    jobs = c.select("id", F.col("id").alias("canonical_url"))
    refs = c.select("id", F.col("id").alias("job_id"), F.lit("s").alias("source_id"), F.col("id").alias("external_id"), F.lit("u").alias("source_url"))
    prints = c.select(F.lit("f").alias("fingerprint"), F.col("id").alias("job_id"))
    out = store.resolve_identity(i, jobs, refs, prints, "k")
    return out.select("k", F.coalesce("identity", F.lit("FOUND")).alias("identity"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as postings: each turn is a collection of one posting, from two sources."""
    c = _read(spark, sf_dir, "conversations")
    conv, source = F.col("conv_id").cast("string"), F.when(F.col("turn") % 3 == 2, "b").otherwise("a")
    url = F.concat(F.lit("https://jobs.example.test/"), conv)
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("position"), F.concat(F.lit("job "), conv).alias("id"), source.alias("source_id"), conv.alias("external_id"), url.alias("source_url"), url.alias("canonical_url"),
        F.sha2(conv, 256).alias("fingerprint"), F.format_string("2026-07-29T10:%02d:00.000Z", "turn").alias("collected_at"), F.col("role").alias("title"), F.lit("Example Labs").alias("company"),
    )


_TURNS = """t AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 THEN 'b' ELSE 'a' END AS source_id, lag(role) OVER w AS before, row_number() OVER w AS n,
   row_number() OVER (PARTITION BY conv_id, CASE WHEN turn % 3 = 2 THEN 'b' ELSE 'a' END ORDER BY turn) AS n_source FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 o AS (SELECT *, CASE WHEN n = 1 THEN 'CREATED' WHEN role <> before THEN 'UPDATED' WHEN n_source = 1 THEN 'LINKED_TO_EXISTING' ELSE 'UNCHANGED' END AS outcome FROM t)"""


@query(f"WITH {_TURNS} SELECT conv_id * 1000 + turn AS position, 'job ' || conv_id AS job_id, outcome, CASE WHEN outcome = 'UPDATED' THEN count_if(outcome = 'UPDATED') OVER (PARTITION BY conv_id ORDER BY turn) END::INT AS revision_number FROM o")
def upsert_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPS03-12, UPS15: postings upserted in order, with revision numbers."""
    turns = _turns(spark, sf_dir)
    return upsert.upsert(turns, upsert.empty_store(turns))[0].select("position", "job_id", "outcome", "revision_number")


@query(f"WITH {_TURNS} SELECT 'job ' || conv_id AS id, arg_max(role, turn) AS title, printf('2026-07-29T10:%02d:00.000Z', min(turn)) AS first_seen_at, printf('2026-07-29T10:%02d:00.000Z', max(turn)) AS last_seen_at, count(DISTINCT source_id) AS n_references, count_if(outcome = 'UPDATED') AS n_revisions FROM o GROUP BY conv_id")
def upserted_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPS05, 06, 08, 10, 11: the store's tables after an upsert, a row a posting."""
    turns = _turns(spark, sf_dir)
    _, after = upsert.upsert(turns, upsert.empty_store(turns))
    n = lambda rows, name: rows.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias(name))
    out = after.jobs.select("id", "title", "first_seen_at", "last_seen_at").join(n(after.references, "n_references"), "id", "left").join(n(after.revisions, "n_revisions"), "id", "left")
    return out.withColumn("n_revisions", F.coalesce("n_revisions", F.lit(0)))


_SOURCES = """c AS (SELECT user_id AS source_id, count(*) AS raw, count_if(value > 90) AS invalid, count_if(event_type = 'click') AS created, count_if(event_type = 'view') AS unchanged, count_if(event_type = 'purchase') AS failed FROM events GROUP BY user_id),
 s AS (SELECT source_id, CASE WHEN source_id % 7 = 0 THEN 'FAILED' WHEN failed > 0 THEN 'PARTIALLY_FAILED' ELSE 'SUCCEEDED' END AS status, CASE WHEN source_id % 7 = 0 THEN 0 ELSE raw END AS raw, CASE WHEN source_id % 7 = 0 THEN 0 ELSE invalid END AS invalid,
   CASE WHEN source_id % 7 = 0 THEN 0 ELSE created END AS created, CASE WHEN source_id % 7 = 0 THEN 0 ELSE unchanged END AS unchanged, CASE WHEN source_id % 7 = 0 THEN 0 ELSE failed END AS failed FROM c)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source results over events: users stand for sources, types for outcomes."""
    e = _read(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "event_type", "value")
    counts = e.groupBy("source_id").agg(F.count("*").alias("raw_job_count"), F.count_if(F.col("value") > 90).alias("invalid_job_count"))
    kind = F.col("event_type")
    outcomes = e.select("source_id", F.when(kind == "click", "CREATED").when(kind == "view", "UNCHANGED").when(kind == "purchase", "JOB_IDENTITY_CONFLICT").alias("outcome"))
    failures = counts.where(F.col("source_id") % 7 == 0).select("source_id", F.lit("HTTP_TIMEOUT").alias("code"), F.lit("The request timed out.").alias("message"))
    return upsert.source_results(counts, outcomes, failures)


@query(f"""WITH {_SOURCES} SELECT source_id, CASE WHEN status = 'SUCCEEDED' THEN 'COMPLETED' ELSE status END AS status, raw::BIGINT AS discovered_count, created::BIGINT AS inserted_count, unchanged::BIGINT AS duplicate_count, invalid::BIGINT AS invalid_count,
 (invalid + failed)::BIGINT AS failed_count, CASE status WHEN 'FAILED' THEN 'HTTP_TIMEOUT' WHEN 'PARTIALLY_FAILED' THEN 'JOB_PERSISTENCE_FAILED' END AS error_code FROM s""")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUN02, RUN04, RUN06: each source's stored result."""
    return upsert.stored_results(_results(spark, sf_dir), "run").select("source_id", "status", "discovered_count", "inserted_count", "duplicate_count", "invalid_count", "failed_count", "error_code")


@query(f"""WITH {_SOURCES} SELECT CASE WHEN bool_and(status = 'FAILED') THEN 'FAILED' WHEN bool_or(status <> 'SUCCEEDED') THEN 'PARTIALLY_FAILED' ELSE 'COMPLETED' END AS status, count(*) AS attempted_source_count, count_if(status <> 'FAILED') AS succeeded_source_count, count_if(status = 'FAILED') AS failed_source_count,
 sum(raw)::BIGINT AS raw_jobs_found, sum(created)::BIGINT AS created_jobs, sum(unchanged)::BIGINT AS duplicate_count, sum(invalid + failed)::BIGINT AS failed_count, count_if(status <> 'SUCCEEDED')::BIGINT AS n_errors FROM s""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUN01, RUN03-08: a collection run's row."""
    out = upsert.run_summary(_results(spark, sf_dir), "run", NOW, NOW)
    errors = F.size(F.from_json("error_summary", "array<struct<sourceId:string,code:string>>")).cast("long").alias("n_errors")
    return out.select("status", "attempted_source_count", "succeeded_source_count", "failed_source_count", "raw_jobs_found", "created_jobs", "duplicate_count", "failed_count", errors)


@query("SELECT event_type, count(*) AS found, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS created, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUN03: totals of counters over sources; users stand for sources, types for runs."""
    results = _read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("found"), F.count_if(F.col("value") > 50).alias("created")).withColumn("users", F.lit(1))
    return store.run_totals(results, ["found", "created", "users"], ["event_type"])


@query("SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'FAILED' WHEN bool_or(o_orderstatus IN ('F', 'P')) THEN 'PARTIALLY_FAILED' ELSE 'COMPLETED' END AS status, count_if(o_orderstatus = 'F') AS failed FROM orders GROUP BY o_custkey")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUN05-08: a run's status over its sources."""
    s = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "PARTIALLY_FAILED").otherwise("COMPLETED")
    return _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(store.collection_status(s, F.lit(False)).alias("status"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))


@query("SELECT 'orders' AS relation, count(*) AS orphans FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey) UNION ALL SELECT 'lineitem', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l.l_partkey) UNION ALL SELECT 'nation', count(*) FROM nation n WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = n.n_regionkey)")
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that lead nowhere, by relation."""
    out = None
    for name, key, parent, parent_key in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("nation", "n_regionkey", "region", "r_regionkey")):
        one = store.orphans(_read(spark, sf_dir, name).select(key), key, _read(spark, sf_dir, parent), parent_key).agg(F.count("*").alias("orphans")).select(F.lit(name).alias("relation"), "orphans")
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT r_name, count(*) AS suppliers, count_if(s_acctbal > 0) AS in_credit FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def geo_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT03-like groups: members by group through two look-ups."""
    s, n, r = (_read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("suppliers"), F.count_if(F.col("s_acctbal") > 0).alias("in_credit"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(html), 'captcha|verify you are human|challenge required') THEN 'captcha' WHEN regexp_matches(lower(html), 'access denied|request blocked|forbidden') THEN 'access-denied' END AS reason FROM pages")
def blocked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT02: pages that show a barrier instead of content."""
    from ..sources.pages import blocked_reason

    return _read(spark, sf_dir, "pages").select("page_id", blocked_reason(F.col("html")).alias("reason"))


@query("SELECT source AS source_id, count(*) AS raw_job_count, count(*) - count(DISTINCT CASE WHEN doc_id % 7 > 0 THEN doc_id % 400 END) AS invalid_job_count, count(DISTINCT CASE WHEN doc_id % 7 > 0 THEN doc_id % 400 END) AS candidate_count FROM documents GROUP BY source")
def board_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC01-04, COL01-12: board payloads built from documents, to postings and counts."""
    from ..operators.collect import normalize_candidates, source_counts
    from ..sources.boards import board_a

    d = _read(spark, sf_dir, "documents")
    item = F.struct((F.col("doc_id") % 400).alias("id"), F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("Engineer "), F.col("lang"))).alias("title"), F.concat(F.lit("https://jobs.example.test/"), F.col("doc_id").cast("string")).alias("absolute_url"), F.struct(F.lit("Berlin").alias("name")).alias("location"))
    # a board's list comes in pages, of 1000 documents' ids at most
    page = F.floor(F.col("doc_id") / 1000).alias("page")
    bodies = d.groupBy(F.col("source").alias("source_id"), page).agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("jobs"))).alias("body")).withColumn("company", F.lit("Example Labs"))
    return source_counts(normalize_candidates(board_a(bodies), F.lit("greenhouse"), NOW))
