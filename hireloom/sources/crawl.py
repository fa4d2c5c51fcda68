"""Sites followed from their first pages over job-like links, breadth first, source by source.

A level is one round for all sources: the frontier is met with the table of pages, its
pages are read together, and their links are the next frontier. What a source may still
read or take up is a window over its own rows, in the order in which links were found,
so one source's size changes nothing for another. A page that is not there, or whose
rendered form is not there when it is needed, is a warning; the others go on.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.collect import first_by_external_id, normalize_candidates
from ..scratch import checkpointed
from .elements import KEY, tasks_for
from .pages import extract

#: Pages and rendered pages a source.
MOST_PAGES, MOST_RENDERED = 60, 10
LIMIT = "TRAVERSAL_LIMIT_REACHED"
#: Sources a task has about, where there is little html.
SOURCES = 10_000


@dataclass
class Crawl:
    """visits: (source_id, url, depth, ordinal, read, rendered, blocked_reason, n_postings, n_links);
    postings: the first of each canonical URL of a source; warnings: (source_id, ordinal, nth, code, message);
    errors: (source_id, code, message) of sources that could not be read at all; tasks: how many all of it is dealt to."""

    visits: DataFrame
    postings: DataFrame
    warnings: DataFrame
    errors: DataFrame
    tasks: int


def _met(frontier: DataFrame, pages: DataFrame, n: int) -> DataFrame:
    """frontier with html, rendered and page of its URLs, in n tasks; of pages of one URL the least counts."""
    rendered = F.col("rendered") if "rendered" in pages.columns else F.lit(None).cast("string")
    # An inner join, and to URLs that are dealt out too: else Spark joins first, in as many tasks as the session says.
    held = pages.select("url", "html", rendered.alias("rendered")).repartition(n, "url").join(frontier.select("url").repartition(n, "url").distinct(), "url")
    held = held.groupBy("url").agg(F.min(F.struct("html", "rendered")).alias("p"))
    met = frontier.join(held, "url", "left").select(*frontier.columns, F.col("p.html").alias("html"), F.col("p.rendered").alias("rendered"))
    return checkpointed(met.withColumn("page", F.xxhash64("html", "company")))


def _read(frontier: DataFrame, pages: DataFrame, n: int, used: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(visits, postings, links, warnings) of a frontier (source_id, url, depth, ordinal and the
    source's settings); used: (source_id, rendered) before it. Html and what is made of it are dealt
    to n tasks wherever they are moved, rows without html too: links and names compress so well that
    Spark's own choice joins very many to a task."""
    by = lambda rows, *keys: rows.repartition(n, *keys)
    met = _met(frontier, pages, n)
    there = met.where("html IS NOT NULL")
    most = frontier.agg(F.max("most_links")).first()[0] or 0
    plain = extract(there.select(*KEY, "company", "html"), most)
    place = ["source_id", "ordinal"]
    visit = [*place, *KEY]
    at = by(there.select(*visit, "company", "allow_browser"), *KEY).join(by(plain.pages.drop("company"), *KEY), KEY)
    wants = by(at.where(F.col("allow_browser") & F.col("browser_reason").isNotNull()), "source_id").join(by(used, "source_id"), "source_id", "left")
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal"))
    wants = wants.withColumn("n", nth + F.coalesce("n_rendered", F.lit(0))).where(F.col("n") <= MOST_RENDERED).select(*visit, "company")
    wants = checkpointed(by(there.select(*place, F.col("rendered").alias("html")), *place).join(by(wants, *place), place).select(*visit, "company", "html"))
    again = wants.where("html IS NOT NULL").withColumn("page", F.xxhash64("html", "company"))
    shown = plain if again.isEmpty() else extract(again.select(*KEY, "company", "html"), most)
    # A left join, as Spark moves an anti join below the dealing.
    static = by(there.select(*visit), *place).join(by(again.select(*place, F.lit(True).alias("_again")), *place), place, "left").where("_again IS NULL").drop("_again")
    where = [(static, plain), (again.select(*visit), shown)]
    of = lambda name: reduce(DataFrame.unionByName, [by(w, *KEY).join(by(getattr(e, name).drop("company") if name == "pages" else getattr(e, name), *KEY), KEY) for w, e in where])
    states, postings, links = checkpointed(of("pages")), checkpointed(of("postings").drop("page")), of("links").drop("page")

    messages = [at.select("source_id", "ordinal", F.lit(0).alias("stage"), "messages", "detections"), by(again.select(*visit), *KEY).join(by(shown.pages, *KEY), KEY).select(*place, F.lit(2).alias("stage"), "messages", F.array().cast("array<struct<provider:string,host:string>>").alias("detections"))]
    said = reduce(DataFrame.unionAll, messages).withColumn("all", F.concat("messages", F.transform("detections", lambda d: F.concat(F.lit("KNOWN_ATS_DETECTED:"), d["provider"]))))
    warned = [said.select("source_id", "ordinal", "stage", F.posexplode("all").alias("nth", "message"))]
    fixed = lambda rows, stage, message: rows.select("source_id", "ordinal", F.lit(stage).alias("stage"), F.lit(0).alias("nth"), F.lit(message).alias("message"))
    warned += [fixed(wants.where("html IS NULL"), 1, "BROWSER_FALLBACK_FAILED"), fixed(met.where("html IS NULL"), 0, "PAGE_EXTRACTION_FAILED")]
    state = states.select(*place, "blocked_reason", "n_postings", "n_links")
    visits = by(met.select("source_id", "url", "depth", "ordinal", F.col("html").isNotNull().alias("read")), *place).join(by(wants.select(*place, F.col("html").isNotNull().alias("rendered")), *place), place, "left").join(by(state, *place), place, "left")
    return checkpointed(visits), postings, checkpointed(links.select(*place, "link", "pos")), checkpointed(reduce(DataFrame.unionAll, warned))


def _ranked(links: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """(source_id, link, at, n, n_taken): links (source_id, link, ordinal, pos) that are not known yet, each
    once and numbered in order, with how many its source took up before; a source's rows are in one of n tasks."""
    found = links.select("source_id", "link", F.struct("ordinal", "pos").alias("at"), F.lit(None).cast("boolean").alias("found"))
    both = found.unionByName(known.select("source_id", "link", "found"), allowMissingColumns=True).repartition(n, "source_id")
    each = both.groupBy("source_id", "link").agg(F.min("at").alias("at"), F.max("found").alias("found"))
    source = Window.partitionBy("source_id")
    new = each.withColumn("n_taken", F.count_if(F.coalesce("found", F.lit(False))).over(source)).where("found IS NULL")
    return new.select("source_id", "link", "at", F.row_number().over(source.orderBy("at")).alias("n"), "n_taken")


def crawl(pages: DataFrame, roots: DataFrame) -> Crawl:
    """roots: url, and where it has them source_id (else the url), company, is_list (whether links are
    followed), depth (0 to 2), most_links (taken up in all), allow_browser. pages: url, html and,
    where a browser has been there, rendered. A source's first root counts."""
    defaults = {"source_id": F.col("url"), "company": F.lit(None).cast("string"), "is_list": F.lit(True), "depth": F.lit(2), "most_links": F.lit(50), "allow_browser": F.lit(True)}
    settings = {k: F.coalesce(F.col(k), v) if k in roots.columns else v for k, v in defaults.items()}
    n = max(tasks_for(pages, *(c for c in ("html", "rendered") if c in pages.columns), tag=0), -(-roots.count() // SOURCES))
    by = lambda rows: rows.repartition(n, "source_id")
    sources = by(roots.where("url IS NOT NULL").select("url", *(v.alias(k) for k, v in settings.items()))).groupBy("source_id").agg(F.min(F.struct("url", "company", "is_list", "depth", "most_links", "allow_browser")).alias("s")).select("source_id", "s.*")
    sources = sources.withColumnRenamed("depth", "deepest")
    if sources.where("NOT (deepest BETWEEN 0 AND 2)").count():
        raise ValueError("depth is 0, 1 or 2")
    sources = checkpointed(sources)
    own = sources.drop("url")
    frontier = sources.select("source_id", "url", F.lit(0).alias("depth"), F.lit(0).alias("ordinal"), *own.columns[1:])
    none = sources.where(F.lit(False))
    visits = postings = warnings = None
    known = sources.select("source_id", F.col("url").alias("link"), F.lit(False).alias("found"))
    depth = 0
    while not frontier.isEmpty():
        used = none.select("source_id", F.lit(0).alias("n_rendered")) if visits is None else by(visits).groupBy("source_id").agg(F.count("rendered").alias("n_rendered"))
        parts = _read(frontier, pages, n, used)
        seen, got, links, said = parts
        visits, postings, warnings = (seen, got, said) if visits is None else (visits.unionAll(seen), postings.unionAll(got), warnings.unionAll(said))
        if depth == 2:
            break
        depth += 1
        # Links of pages in order, each once; those taken up before do not count again.
        links = by(links).join(by(own), "source_id")
        links = links.withColumn("n", F.row_number().over(Window.partitionBy("source_id", "ordinal").orderBy("pos"))).where("n <= most_links").drop("n")
        goes_on = F.col("is_list") & (F.col("deepest") >= depth)
        if depth == 1:  # a source that follows nothing says so if there was something
            stopped = links.where(~goes_on).select("source_id", "ordinal").distinct()
            warnings = warnings.unionAll(_limit(stopped, 3))
        ranked = checkpointed(_ranked(links.where(goes_on), known, n).join(by(own), "source_id"))
        fits = F.col("n") + F.col("n_taken") <= F.col("most_links")
        warnings = warnings.unionAll(_limit(by(ranked.where(~fits)).select("source_id", F.col("at.ordinal").alias("ordinal")).distinct(), 3))
        new = by(ranked.where(fits))
        known = checkpointed(known.unionAll(new.select("source_id", "link", F.lit(True).alias("found"))))
        # Pages that are still to be read: those that are missing did not use up any.
        read = by(visits).groupBy("source_id").agg(F.count_if("read").alias("n_read"), F.max("ordinal").alias("last"))
        room = new.join(read, "source_id").withColumn("room", F.col("n") <= MOST_PAGES - F.col("n_read"))
        full = room.where("NOT room").groupBy("source_id").agg(F.max("last").alias("ordinal"))
        warnings = checkpointed(warnings.unionAll(_limit(full, 4)))
        frontier = checkpointed(room.where("room").select("source_id", F.col("link").alias("url"), F.lit(depth).alias("depth"), (F.col("last") + F.col("n")).cast("int").alias("ordinal"), *own.columns[1:]))
        visits = checkpointed(visits)
    if visits is None:
        visits, postings, _, warnings = _read(frontier, pages, n, none.select("source_id", F.lit(0).alias("n_rendered")))
    failed = visits.where("depth = 0 AND (NOT read OR blocked_reason IS NOT NULL)").select("source_id", F.when(~F.col("read"), "PAGE_EXTRACTION_FAILED").otherwise("BLOCK_PAGE_DETECTED").alias("code"), F.when(~F.col("read"), "The source's page could not be read.").otherwise(F.concat(F.lit("Generic source returned a "), "blocked_reason", F.lit(" page."))).alias("message"))
    unique = first_by_canonical(postings.repartition(n, "source_id", "canonical_url"))
    known_code = F.when(F.col("message").startswith("KNOWN_ATS_DETECTED"), "KNOWN_ATS_DETECTED").when(F.col("message").isin("BROWSER_FALLBACK_FAILED", LIMIT), F.col("message")).otherwise("PAGE_EXTRACTION_FAILED")
    order = F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal", "stage", "nth", "message")).alias("nth")
    return Crawl(visits, unique, by(warnings).select("source_id", "ordinal", order, known_code.alias("code"), "message"), failed, n)


def _limit(rows: DataFrame, stage: int) -> DataFrame:
    return rows.select("source_id", "ordinal", F.lit(stage).alias("stage"), F.lit(0).alias("nth"), F.lit(LIMIT).alias("message"))


def first_by_canonical(postings: DataFrame) -> DataFrame:
    """The first posting of each canonical URL of a source."""
    w = Window.partitionBy("source_id", "canonical_url").orderBy("ordinal", "nth")
    return postings.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def _metadata() -> Column:
    """The extraction's strategy, confidence and evidence beside what the posting says, as JSON."""
    plain = F.struct(
        F.col("strategy").alias("extractionStrategy"), F.col("confidence").alias("extractionConfidence"), "evidence", "confidence", F.col("direct_apply").alias("directApply"), "industry", F.col("occupational_category").alias("occupationalCategory"),
        F.parse_json("base_salary").alias("baseSalary"),
    )
    return F.to_json(plain)


def page_postings(pages: DataFrame, roots: DataFrame, source_type: Column, collected_at: str) -> tuple[DataFrame, Crawl]:
    """Postings of crawled sites in the shape that is stored, with a column rejected
    (JOB_NORMALIZATION_FAILED's reason), and the crawl they come from. source_type may name
    the column type of roots."""
    crawled = crawl(pages, roots)
    items = crawled.postings.select(
        "source_id", F.coalesce("external_id", "canonical_url").alias("external_id"), "title", F.col("canonical_url").alias("source_url"), "company", "application_url", "description", "location_text", F.lit(None).cast("string").alias("department"),
        F.col("employment_type").alias("raw_employment_type"), F.col("workplace_type").alias("raw_workplace_type"), "published_at", "expires_at", _metadata().alias("metadata"), "ordinal", "nth",
    )
    if "type" in roots.columns:
        items = items.repartition(crawled.tasks, "source_id").join(roots.select("source_id", "type").repartition(crawled.tasks, "source_id").dropDuplicates(["source_id"]), "source_id")
    items = items.repartition(crawled.tasks, "source_id", "external_id")
    return normalize_candidates(first_by_external_id(items.withColumn("order", F.struct("ordinal", "nth")), "order").withColumn("order", F.concat(F.lpad(F.col("ordinal").cast("string"), 10, "0"), F.lpad(F.col("nth").cast("string"), 10, "0"))).drop("ordinal", "nth"), source_type, collected_at), crawled
