"""Queries over pages: those of the driver, and sites that Spark builds from documents, with SQL for the latter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from ..sources.crawl import MOST_PAGES, crawl
from ..sources.crawl import page_postings as crawled_postings
from ..sources.elements import KEY, beside_texts, inner, labelled_values, nodes
from ..sources.pages import MOST_BLOCKS, extract, page_tree
from .postings import POSTINGS_SQL, postings
from .queries import NOW, query

#: Documents of a source that one list page links at most, and documents whose list items one task puts together about.
A_LIST, A_TASK = 2000, 50_000


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html", F.lit("Example Labs").alias("company"))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query()
def element_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT16-17: elements of every page by name, with the characters of text inside them and their depth."""
    of = beside_texts(nodes(_pages(spark, sf_dir)), F.col("name").isNotNull(), ["name", "idx", "last", "depth"])
    return of.groupBy("url", "name").agg(F.count("*").alias("elements"), F.sum(F.length(inner())).alias("chars"), F.max("depth").alias("deepest"))


@query(f"""SELECT id, trim(regexp_replace(place, '\\s+', ' ', 'g')) AS location, trim(regexp_replace(salary_text, '\\s+', ' ', 'g')) AS salary, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS team FROM ({POSTINGS_SQL})""")
def labelled_page_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT22: values beside their labels, in lists, tables and text, end tags left out or not."""
    p = postings(spark, sf_dir).select("id", "title", F.get_json_object("metadata", "$.locationText").alias("place"), F.get_json_object("metadata", "$.salaryText").alias("salary"))
    dt = F.when(F.col("id").endswith("1"), "</dt>").otherwise("")
    html = F.concat(
        F.lit("<main><dl><dt>Location:"), dt, F.lit("<dd>"), _escaped(F.col("place")), F.lit("<dt>Other<dd>none</dl><table><tr><td><table><tr><th>Salary<td>"), _escaped(F.col("salary")), F.lit("<tr><th>x</table></table><p><b> TEAM </b><i>"), _escaped(F.col("title")), F.lit("</i><b>Team</b><i>later</i></main>"),
    )
    tree = page_tree(p.select(F.col("id").alias("url"), html.alias("html")))
    values = labelled_values(tree, ["location", "salary", "team"])
    return values.groupBy(F.col("url").alias("id")).pivot("label", ["location", "salary", "team"]).agg(F.first("value"))


def _job_ld(p: DataFrame) -> DataFrame:
    """Pages whose JobPosting is in a list in a graph in a list; some are no JSON, lack fields or are not alone."""
    i = F.col("id").cast("long")
    job = F.struct(
        F.array(F.lit("Thing"), F.lit("JobPosting")).alias("@type"), F.when(i % 7 > 0, F.col("title")).alias("title"), F.col("description"), F.struct(F.col("company").alias("name")).alias("hiringOrganization"),
        F.struct(i.alias("value")).alias("identifier"), F.concat(F.lit("/jobs/"), i).alias("url"),
    )
    graph = F.to_json(F.struct(F.array(F.struct(F.lit("Other").alias("@type")).alias("o")).alias("@graph"), F.lit("x").alias("n")))
    nested = F.concat(F.lit('[[{"@graph":['), graph, F.lit(',{"@graph":[[['), F.to_json(job), F.lit("]]]}]}]]"))
    body = F.when(i % 11 == 0, "{not json").otherwise(F.when(i % 13 == 0, F.concat(F.lit("["), F.to_json(job), F.lit(","), F.to_json(job), F.lit("]"))).otherwise(nested))
    script = lambda x: F.concat(F.lit('<script type=" Application/LD+JSON">'), x, F.lit("</script>"))
    more = F.when(i % 17 == 0, F.repeat(script(F.lit("{}")), MOST_BLOCKS)).otherwise(F.lit(""))
    return p.select("id", F.concat(F.lit("https://jobs.example.test/page/"), i).alias("url"), F.concat(F.lit("<!-- "), script(F.lit("{}")), F.lit(" --><p>x"), script(body), more).alias("html"), F.lit("Example Labs").alias("company"))


@query(f"""WITH p AS (SELECT doc_id, title, company, doc_id % 7 > 0 AS titled, doc_id % 11 = 0 AS broken, doc_id % 13 = 0 AS twice, doc_id % 17 = 0 AS many FROM ({POSTINGS_SQL}))
SELECT 'https://jobs.example.test/page/' || doc_id AS url, CASE WHEN titled AND NOT broken THEN CASE WHEN twice THEN 2 ELSE 1 END ELSE 0 END::BIGINT AS n_postings,
  CASE WHEN titled AND NOT broken THEN title END AS title, CASE WHEN titled AND NOT broken THEN trim(regexp_replace(company, '\\s+', ' ', 'g')) END AS company, CASE WHEN titled AND NOT broken THEN 'https://jobs.example.test/jobs/' || doc_id END AS canonical_url, CASE WHEN titled AND NOT broken THEN doc_id::VARCHAR END AS external_id,
  array_to_string(list_concat(CASE WHEN broken THEN ['A malformed JSON-LD block was skipped.'] ELSE [] END, CASE WHEN many THEN ['The JSON-LD block limit was reached.'] ELSE [] END,
    CASE WHEN NOT broken AND NOT titled THEN CASE WHEN twice THEN ['A malformed or incomplete JobPosting object was skipped.', 'A malformed or incomplete JobPosting object was skipped.'] ELSE ['A malformed or incomplete JobPosting object was skipped.'] END ELSE [] END), '|') AS messages FROM p""")
def json_ld_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT03-13, EXT26: JSON-LD at any depth, what is skipped, and the page's warnings in order."""
    found = extract(_job_ld(postings(spark, sf_dir)).drop("id"))
    first = found.postings.groupBy(*KEY).agg(*(F.min_by(c, "nth").alias(c) for c in ("title", "company", "canonical_url", "external_id")))
    return found.pages.drop("company").join(first, KEY, "left").select("url", "n_postings", "title", "company", "canonical_url", "external_id", F.array_join("messages", "|").alias("messages"))


def _site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A list page for each source and A_LIST ids, and a page a document that says its text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    site = F.concat(F.lit("https://"), F.coalesce("source", F.lit("none")), F.lit("-"), F.floor(F.col("doc_id") / A_LIST), F.lit(".example.test/"))
    d = d.withColumn("site", F.lower(site))
    item = F.concat(F.lit('<li><a href="/jobs/'), "doc_id", F.lit('">Job</a>'))
    lists = d.repartition(max(1, -(-d.count() // A_TASK)), "site").groupBy("site").agg(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("items"))
    lists = lists.select(F.col("site").alias("url"), F.concat(F.lit("<nav><a href='/jobs/0'>no</a></nav><ul class='open-jobs'>"), F.array_join(F.transform("items", lambda x: x["item"]), ""), F.lit("</ul>")).alias("html"))
    body = F.concat(F.lit("<title>Job</title><article><h1>Job "), "doc_id", F.lit("</h1><nav>menu</nav><p>"), _escaped(F.col("text")), F.lit("</p><ul class=jobs><li><a href='/'>All jobs</a></ul></article>"))
    return lists, d.select(F.concat("site", F.lit("jobs/"), "doc_id").alias("url"), body.alias("html")).unionAll(lists)


@query(f"""WITH d AS (SELECT lower('https://' || coalesce(source, 'none') || '-' || (doc_id // {A_LIST}) || '.example.test/') AS source_id, doc_id, row_number() OVER (PARTITION BY lower('https://' || coalesce(source, 'none') || '-' || (doc_id // {A_LIST}) || '.example.test/') ORDER BY doc_id) AS n FROM documents),
r AS (SELECT source_id, doc_id FROM d WHERE n <= {MOST_PAGES - 1})
SELECT source_id, count(*) + 1 AS pages, count(*) AS postings, min(doc_id) AS first_id, sum(doc_id)::BIGINT AS ids, (SELECT count(*) FROM d WHERE d.source_id = r.source_id AND n = {MOST_PAGES}) AS warnings FROM r GROUP BY source_id""")
def crawled_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT24-28: sites followed from their list pages, {MOST_PAGES} pages each, and what they gave."""
    lists, pages = _site(spark, sf_dir)
    found = crawl(pages, lists.select("url", F.lit("Example Labs").alias("company"), F.lit(1).alias("depth"), F.lit(10 * A_LIST).alias("most_links")))
    ids = F.regexp_extract("canonical_url", r"/jobs/(\d+)$", 1).cast("long")
    by = lambda rows, *columns: rows.select("source_id", *columns).repartition(found.tasks, "source_id").groupBy("source_id")
    of = by(found.postings, ids.alias("id")).agg(F.count("*").alias("postings"), F.min("id").alias("first_id"), F.sum("id").alias("ids"))
    out = by(found.visits).agg(F.count("*").alias("pages")).join(of, "source_id", "left").join(by(found.warnings).agg(F.count("*").alias("warnings")), "source_id", "left")
    return out.select("source_id", "pages", F.coalesce("postings", F.lit(0)).alias("postings"), "first_id", "ids", F.coalesce("warnings", F.lit(0)).alias("warnings"))


@query()
def page_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT01, EXT25-28: every page of the table read by itself, to postings that can be stored or why not."""
    pages = _pages(spark, sf_dir)
    good, _ = crawled_postings(pages, pages.select("url", "company", F.lit(False).alias("is_list"), F.lit(0).alias("depth")), F.lit("generic-page"), NOW)
    return good.select("source_id", "external_id", "title", "company", "description", "application_url", "metadata", "rejected")


@query()
def semantic_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT14-16, EXT21: postings from headings and content."""
    from ..sources.pages import semantic_jobs

    return semantic_jobs(_pages(spark, sf_dir)).select("url", clean(F.col("title")).alias("title"), "company", "description", "application_url", "location_text", "employment_type", "confidence", "strategy")
