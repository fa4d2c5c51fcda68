"""A view of postings over the driver's tables, the same in Spark and in DuckDB.

Documents carry no job vocabulary, so titles, places, salaries and requirements come
from fixed lists, picked by the document's id; text, source and language are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = [
    "Senior Data Engineer", "Junior Analyst (m/f/d)", "Lead Scientist", "Director of Sales", "Staff Engineer, Platform", "VP of Product", "Data Scientist", "Software Engineering Internship",
    "Team Lead Support", "Chief Technology Officer", "Sr. Developer", "Entry-level Tester", "Executive Assistant", "Principal Architect", "Office Manager", "Machine Learning Engineer", "CTO", "Managing Director",
]
COMPANIES = ["Example Labs GmbH", "Northwind Ltd", "ACME, Inc.", "Blue & Green AG", "example  labs", "Contoso", "Fabrikam S.A."]
PLACES = ["Remote within the EU", "Remote - US only", "Hybrid - Milan", "Berlin, Germany", "Remote", "Remote worldwide", "London, United Kingdom", "Paris, France", "Remote (Europe)", "Remote, utc+2", "Vienna AT", "On site"]
SALARIES = ["EUR 500-700 per day gross", "Competitive", "$ 120,000 per year", "GBP 45.000 - 60.000 annual net", "60k EUR", "USD 30 hourly", "EUR 3,500.50 per month"]
REQUIREMENTS = [
    "At least 3-5 years of relevant experience required.", "Up to 2 years experience preferred.", "10+ years of experience is a must.", "Candidates must have a PhD degree.", "A bachelor's degree is required or equivalent experience.",
    "German C1 proficiency is required.", "English native speaker preferred; Deutsch B2 required.", "Must be authorized to work in Germany.", "EU citizens only.", "No sponsorship; security clearance is required.", "Python and SQL, Postgres nice to have.", "We use TypeScript and node.js.", "Master's degree preferred.",
]
SUFFIXES = ["gmbh", "ltd", "inc", "ag"]
LISTS = {"title": TITLES, "company": COMPANIES, "place": PLACES, "salary": SALARIES, "requirement": REQUIREMENTS}


def pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings in the input shape of normalize()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # a file of one row group is one task otherwise
        docs = docs.repartition(cores)
    i = F.col("doc_id")
    null = lambda kind: F.lit(None).cast(kind)
    url = F.concat(F.lit("https://jobs.example.test/"), (i % 997).cast("string"))
    return docs.select(
        F.lpad(i.cast("string"), 12, "0").alias("id"), F.col("source").alias("source_id"), (i % 499).cast("string").alias("external_id"), url.alias("source_url"), url.alias("canonical_url"),
        F.concat(url, F.lit("/?utm_source=x&b=2&a="), (i % 3).cast("string")).alias("application_url"), pick(TITLES, i).alias("title"), pick(COMPANIES, i).alias("company"),
        F.concat_ws(" ", pick(REQUIREMENTS, i), pick(REQUIREMENTS, F.floor(i / 13))).alias("description"), F.array().cast("array<struct<country:string,city:string,region:string>>").alias("locations"),
        F.when(i % 4 == 0, "remote").alias("remote_policy"), F.when(i % 3 == 0, "full-time").alias("employment_type"), null("double").alias("salary_minimum"), null("double").alias("salary_maximum"),
        null("string").alias("salary_currency"), null("string").alias("salary_period"), null("string").alias("published_at"), F.when(i % 11 == 0, "2026-07-28T00:00:00Z").alias("expires_at"),
        F.lit("2026-07-28T12:00:00Z").alias("first_seen_at"), F.lit("2026-07-29T10:00:00Z").alias("last_collected_at"),
        F.to_json(F.struct(pick(PLACES, i).alias("locationText"), pick(SALARIES, i).alias("salaryText"), F.col("lang").alias("industry"))).alias("metadata"), F.lit(0).alias("input_revision_number"),
    )


def _sql(values: list[str], n: str) -> str:
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{items}])[(({n}) % {len(values)} + 1)::INT]"


#: The view in DuckDB: id, source_id, external_id, url, title, company, description, place, salary ...
POSTINGS_SQL = f"""SELECT doc_id, lpad(doc_id::VARCHAR, 12, '0') AS id, source AS source_id, (doc_id % 499)::VARCHAR AS external_id, lang AS industry,
  'https://jobs.example.test/' || (doc_id % 997)::VARCHAR || '?a=' || (doc_id % 3)::VARCHAR || '&b=2' AS identity_url,
  {_sql(TITLES, "doc_id")} AS title, {_sql(COMPANIES, "doc_id")} AS company, {_sql(PLACES, "doc_id")} AS place, {_sql(SALARIES, "doc_id")} AS salary_text,
  {_sql(REQUIREMENTS, "doc_id")} || ' ' || {_sql(REQUIREMENTS, "doc_id // 13")} AS description,
  CASE WHEN doc_id % 4 = 0 THEN 'remote' END AS remote_policy, CASE WHEN doc_id % 3 = 0 THEN 'full-time' END AS employment_type, doc_id % 11 = 0 AS expired
FROM documents"""
