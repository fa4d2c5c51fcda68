"""Queries over stored rows: mapping, own errors, changes, runs, addresses; rows are built from the driver's tables, the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import PRIVATE_V4, PRIVATE_V6, is_public, v4_value
from ..operators import store
from ..operators.mapping import CODE, JOB_RULES, mapped
from ..operators.process import decide
from ..operators.runs import states
from .postings import pick, postings
from .queries import CANDIDATE, CONFIG, NOW, query

STATUSES = ["NEW", "VIEWED", "APPLIED", "NEW", "GONE", "EXPIRED", "NEW"]
POLICIES = ["remote", "hybrid", "onsite", "anywhere", "remote"]
TIMES = ["2026-01-02T03:04:05Z", "2026-01-02", "yesterday"]
LOCATIONS = ['[{"country":"IT","city":"Rome"}]', '[{"city":"Rome"}]', "[]", '{"country":"IT"}', '[{"country":"IT"}]', '[{"country":7}]']
SKILLS = ['["a","b"]', "[]", '["a",1]', '["c"]', "none"]


def _list(values: list[str], n: str) -> str:
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{items}])[(({n}) % {len(values)} + 1)::INT]"


def _messages(*fields: str) -> list[tuple[str, str]]:
    return [(r.field, r.message) for f in fields for r in JOB_RULES if r.field == f]


_BROKEN = [
    (f"{_list(STATUSES, 'doc_id')} = 'GONE'", *_messages("current_status")[0]), (f"{_list(POLICIES, 'doc_id // 2')} = 'anywhere'", *_messages("remote_policy")[0]),
    (f"{_list(LOCATIONS, 'doc_id // 3')} LIKE '{{%'", *_messages("locations")[0]), (f"{_list(LOCATIONS, 'doc_id // 3')} IN ('[{{\"city\":\"Rome\"}}]', '[{{\"country\":7}}]')", *_messages("locations")[1]),
    (f"{_list(SKILLS, 'doc_id // 5')} IN ('[\"a\",1]', 'none')", *_messages("normalized_skills")[0]), ("doc_id % 19 = 0 OR doc_id % 23 = 0", *_messages("salary_minimum")[0]), (f"{_list(TIMES, 'doc_id // 7')} = 'yesterday'", *_messages("published_at")[0]),
]


def _case(k: int) -> str:
    return "CASE " + " ".join("WHEN {} THEN '{}'".format(b[0], b[k].replace("'", "''")) for b in _BROKEN) + " END"


@query(f"SELECT doc_id AS id, CASE WHEN {_case(1)} IS NOT NULL THEN '{CODE}' END AS code, {_case(1)} AS field, {_case(2)} AS message FROM documents")
def mapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPS16, UPS17: stored rows that can be read, and those that can't with the field and why."""
    i = F.col("doc_id")
    salary = F.when(i % 19 == 0, float("nan")).when(i % 23 == 0, float("inf")).otherwise(F.col("n_chars").cast("double"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        i.alias("id"), pick(STATUSES, i).alias("current_status"), pick(POLICIES, F.floor(i / 2)).alias("remote_policy"), salary.alias("salary_minimum"), pick(TIMES, F.floor(i / 7)).alias("published_at"),
        pick(LOCATIONS, F.floor(i / 3)).alias("locations"), pick(SKILLS, F.floor(i / 5)).alias("normalized_skills"),
    )
    good, bad = mapped(d)
    none = F.lit(None).cast("string")
    return good.select("id", none.alias("code"), none.alias("field"), none.alias("message")).unionByName(bad.select("id", "code", "field", "message"))


@query(f"SELECT lpad(doc_id::VARCHAR, 12, '0') AS job_id, doc_id % 5 = 0 OR doc_id % 7 = 0 AS failed, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN '{CODE}' END AS error_code, CASE WHEN doc_id % 5 = 0 THEN 'remote_policy' WHEN doc_id % 7 = 0 THEN 'metadata' END AS error_field FROM documents")
def processing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRC10: postings of their own error beside decided ones."""
    i = F.col("id").cast("long")
    jobs = postings(spark, sf_dir).withColumns({"remote_policy": F.when(i % 5 == 0, "somewhere").otherwise(F.col("remote_policy")), "metadata": F.when(i % 7 == 0, "{not json").otherwise(F.col("metadata"))})
    made = decide(jobs, CANDIDATE, CONFIG, NOW)
    return made.select("job_id", (F.col("processing_status") == "ERROR").alias("failed"), "error_code", "error_field")


_N = len(store.MEANINGFUL)


@query(f"""SELECT doc_id, array_to_string(list_concat(CASE WHEN doc_id % {_N + 2} < {_N} AND ([{", ".join(f"'{f}'" for f in store.MEANINGFUL)}])[(doc_id % {_N + 2} + 1)::INT] <> 'metadata' THEN [([{", ".join(f"'{f}'" for f in store.MEANINGFUL)}])[(doc_id % {_N + 2} + 1)::INT]] ELSE [] END,
  CASE WHEN doc_id % 3 = 0 OR doc_id % {_N + 2} = {_N - 1} THEN ['metadata'] ELSE [] END), ',') AS changed FROM documents""")
def meaningful_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPS07: changes of all meaningful fields; lists and objects by value, absence is none."""
    i = F.col("doc_id")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(i, "lang", "source")
    one = {f: F.concat_ws(" ", F.lit(f), "source").alias(f) for f in store.MEANINGFUL} | {
        "salary_minimum": (i % 100).cast("double").alias("salary_minimum"), "salary_maximum": (i % 100 + 5).cast("double").alias("salary_maximum"), "locations": F.array(F.struct(F.col("lang").alias("country"), F.lit("x").alias("city"))).alias("locations"),
        "skills": F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)).alias("skills"), "normalized_skills": F.array(F.lit("a"), F.col("lang")).alias("normalized_skills"), "required_languages": F.array(F.struct(F.lit("en").alias("code"))).alias("required_languages"),
        "metadata": F.concat(F.lit('{"b": {"y": [1, 2.0], "x": "'), "lang", F.lit('"}, "a": 1}')).alias("metadata"),
    }
    other = dict(one) | {"skills": F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(1)).alias("skills")}
    other["metadata"] = F.concat(F.lit('{"a":1,"b":{"x":"'), "lang", F.when(i % 3 == 0, '","y":[2,1]}}').otherwise('","y":[1,2]}}')).alias("metadata")

    def changed(k: int, f: str) -> Column:
        """Field k of new: another value where it is the row's turn, absent two rows on."""
        value = one[f] if f not in ("skills", "metadata") else other[f]
        more = {"salary_minimum": value + 1, "salary_maximum": value + 1, "locations": F.array(F.struct(F.lit("xx").alias("country"), F.lit("x").alias("city"))), "skills": F.create_map(F.lit("a"), F.lit(3)), "normalized_skills": F.array(F.lit("z")), "required_languages": F.array(F.struct(F.lit("de").alias("code"))), "metadata": F.lit('{"a":2}')}
        turn = i % (_N + 2)
        own = F.when(turn == k, more.get(f, F.concat(value, F.lit("!"))))
        return (own if f == "metadata" else own.when(turn == (k + 2) % (_N + 2), F.lit(None))).otherwise(value).alias(f)

    both = d.select(i, F.struct(*one.values()).alias("old"), F.struct(*(changed(k, f) for k, f in enumerate(store.MEANINGFUL))).alias("new"))
    kinds = store.kinds_of(both.select("old.*"))
    return both.select("doc_id", F.array_join(store.changed_fields(store.MEANINGFUL, kinds=kinds), ",").alias("changed"))


@query("""WITH e AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS event, CASE event_type WHEN 'purchase' THEN CASE WHEN value > 50 THEN 'FAILED' ELSE 'COMPLETED' END ELSE 'STARTED' END AS status, event_id, ts FROM events),
f AS (SELECT user_id, event, arg_min(status, (ts, event_id)) AS status, min(ts) AS at FROM e GROUP BY user_id, event)
SELECT o.user_id::VARCHAR AS run_id, coalesce(c.status, 'STARTED') AS status, c.user_id IS NOT NULL AS closed FROM f o LEFT JOIN f c ON c.user_id = o.user_id AND c.event = 1 WHERE o.event = 0""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRC13, RUN01: runs of the rows that open and close them; users stand for runs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    buys = F.col("event_type") == "purchase"
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    rows = e.select(F.col("user_id").cast("string").alias("run_id"), buys.cast("int").alias("event"), F.when(buys, F.when(F.col("value") > 50, "FAILED").otherwise("COMPLETED")).otherwise("STARTED").alias("status"), at.alias("at"), F.lit("query").alias("initiated_by"), F.lit("{}").alias("counts"), F.lit("{}").alias("versions"))
    return states(rows).select("run_id", "status", F.col("completed_at").isNotNull().alias("closed"))


_V4 = "((doc_id * 2654435761 + 97) % 4294967296)"
_FIRST = "((doc_id * 40503 + 11) % 65536)"
_IN_V4 = " OR ".join(f"{{n}} BETWEEN {v4_value(a)} AND {v4_value(b)}" for a, b in PRIVATE_V4)
_IN_V6 = " OR ".join(f"{_FIRST} BETWEEN {a} AND {b}" for a, b in PRIVATE_V6)


@query(f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NOT ({_IN_V4.format(n=_V4)}) WHEN 1 THEN NOT ({_IN_V6}) WHEN 2 THEN NOT ({_IN_V4.format(n=_V4)}) WHEN 3 THEN NOT ({_IN_V4.format(n=_V4)}) ELSE false END AS public FROM documents""")
def public_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NET05: which of many IPv4, IPv6, mapped and malformed addresses are public."""
    i = F.col("doc_id")
    v4, first = (i * 2654435761 + 97) % 4294967296, (i * 40503 + 11) % 65536
    byte = lambda k: (F.floor(v4 / 2.0**k) % 256).cast("string")
    dotted = F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))
    half = lambda x: F.lower(F.hex(x.cast("long")))
    v6 = F.concat(F.lit("["), half(first), F.lit("::"), half(i % 65536), F.lit("]"))
    mapped_hex = F.concat(F.lit("::ffff:"), half(F.floor(v4 / 65536)), F.lit(":"), half(v4 % 65536))
    address = F.when(i % 5 == 0, dotted).when(i % 5 == 1, v6).when(i % 5 == 2, mapped_hex).when(i % 5 == 3, F.concat(F.lit("::FFFF:"), dotted)).otherwise(F.concat(dotted, F.lit(".1")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", is_public(address).alias("public"))
