"""Pages (url, html, company) to postings, links, detections and warnings.

A page's markup becomes an element table (elements.py); what a page shows is found in
it by windows and joins. Structured data comes from JSON-LD blocks by way of variants.
extract() puts the stages together as a page's state asks for; crawl.py follows links.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, decode_entities, held, let, presence
from ..functions.urls import normalize_url
from ..operators.collect import iso_timestamp
from ..scratch import checkpointed
from .elements import KEY, attribute, beside_texts, block_text, dealt, has_class, held_tree, inner, inner_texts, is_item, labelled_values, nodes

#: Limits, and the patterns and hosts by which links and boards are told.
MOST_BLOCKS, MOST_BLOCK_BYTES, MOST_DESCRIPTION = 20, 512 * 1024, 50_000
JOB_PATH = r"(?i)/(?:job|jobs|career|careers|position|positions|opening|openings|vacanc(?:y|ies)|role|roles)(?:/|$)"
EXCLUDED_LINK = r"(?i)(?:privacy|cookie|login|sign-in|search|filter|category|location|department|page=|mailto:|tel:|javascript:)"
JOB_TEXT = r"(?i)apply|engineer|developer|manager|designer|analyst|role|position|opening"
APPLY_TEXT = r"(?i)^(?:apply|apply now|submit application)$"
ATS_HOSTS = {"boards.greenhouse.io": "greenhouse", "job-boards.greenhouse.io": "greenhouse", "boards-api.greenhouse.io": "greenhouse", "jobs.lever.co": "lever", "api.lever.co": "lever"}
NOISE = ["script", "style", "noscript", "svg", "canvas", "iframe", "template", "nav", "footer"]
LINE_ENDS = ["br", "p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "dt", "dd"]

#: What stands before the body, said or not: the first other tag or text begins it.
_HEAD = r"(?is)\A\s*+(?:(?:<!doctype\b[^>]*>|</?(?:html|head|noscript)(?=[\s/>])[^>]*>|<(?:meta|link|base)\b[^>]*>|<(script|style|title|template)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\z))\s*+)*+"


def inner_text(html: Column) -> Column:
    """Text of a piece of markup on one line; null if there is none."""
    return presence(clean(decode_entities(F.regexp_replace(html, r"<[^>]*>", ""))))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def ats_provider(url: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ATS_HOSTS.items() for x in kv]), host(url))


def blocked_reason(html: Column) -> Column:
    """Of the first 20,000 characters of the title and the body, as the reference joins them:
    styles and scripts of the head are not in it, those of the body are."""
    page = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    title = F.regexp_extract(F.regexp_extract(page, _HEAD, 0), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    text = F.regexp_replace(F.concat(title, F.regexp_replace(page, _HEAD, "")), r"<[^>]*>", "")
    body = F.left(F.lower(decode_entities(text)), F.lit(20_000))
    return F.when(body.rlike("captcha|verify you are human|challenge required"), "captcha").when(body.rlike("sign in to continue|log in to continue|authentication required"), "login").when(body.rlike("access denied|request blocked|forbidden"), "access-denied")


def resolve(href: Column, base: Column, cross: bool = True) -> Column:
    """An absolute https URL without fragment: of the same origin or, with cross, a known board's."""
    return let(F.btrim(decode_entities(href)), lambda raw: _resolve(raw, base, cross))


def resolved(href: str, base: str = "url", cross: bool = True) -> Column:
    """resolve() of columns by their names."""
    return held(f"resolve {href} {base} {cross}", lambda: resolve(F.col(href), F.col(base), cross))


def _resolve(raw: Column, base: Column, cross: bool) -> Column:
    directory = F.regexp_extract(base, r"^([^?#]*/)", 1)
    absolute = F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), raw).when(raw.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), raw)).when(raw.startswith("/"), F.concat(origin(base), raw)).when(raw == "", base).when(raw.startswith("#"), F.concat(F.substring_index(base, "#", 1), raw)).when(raw.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), raw)).otherwise(F.concat(directory, raw))

    def allowed(value: Column) -> Column:
        own = origin(value) == origin(base)
        return F.when(own | ats_provider(value).isNotNull() if cross else own, value)

    return let(normalize_url(absolute)["value"], allowed)


def page_tree(pages: DataFrame) -> DataFrame:
    """The element tree of pages, with marks for the areas of job links and for what is no content."""
    name = F.col("name")
    hidden = attribute("hidden").isNotNull() | F.coalesce(attribute("aria-hidden") == "true", F.lit(False))
    return nodes(pages, {"area": name.isin("main", "article") | has_class("job"), "noise": name.isin(NOISE) | hidden | has_class("cookie")})


def canonical_links(tree: DataFrame) -> DataFrame:
    """(url, page, canonical): what the first link of rel canonical leads to, if it is of the page's origin."""
    rel = F.array_contains(F.split(F.lower(attribute("rel")), r"\s+"), "canonical")
    first = tree.where((F.col("name") == "link") & rel).groupBy(*KEY).agg(F.min_by("attrs", "pos").alias("attrs"))
    return first.select(*KEY, attribute("href").alias("href")).select(*KEY, resolved("href", cross=False).alias("canonical")).where("canonical IS NOT NULL")


# -- structured data


def _one(v: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.col(v)).startswith("ARRAY"), F.lit(False))


def json_ld(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects (url, page, block, path, object) and rejects (url, page, block, message).

    Objects of type JobPosting at any depth of lists and of @graph lists, in the order of
    (block, path); lists are taken apart a level at a time until none is left. Blocks that
    are no JSON, too large or beyond the limit of a page are rejects.
    """
    is_block = (F.col("name") == "script") & (F.lower(F.btrim(attribute("type"))) == "application/ld+json")
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("pos")) - 1
    blocks = tree.where(is_block).select(*KEY, nth.alias("block"), F.btrim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("text"))
    sized = F.octet_length("text") <= MOST_BLOCK_BYTES
    read = checkpointed(blocks.where((F.col("text") != "") | (F.col("block") == MOST_BLOCKS)).withColumn("v", F.when(sized & (F.col("block") < MOST_BLOCKS), F.try_parse_json("text"))).select(*KEY, "block", sized.alias("sized"), "v"))
    said = F.when(F.col("block") == MOST_BLOCKS, "The JSON-LD block limit was reached.").when(~F.col("sized"), "An oversized JSON-LD block was skipped.").otherwise("A malformed JSON-LD block was skipped.")
    rejects = read.where(F.col("v").isNull() & (F.col("block") <= MOST_BLOCKS)).select(*KEY, "block", said.alias("message"))
    rows = read.where("v IS NOT NULL").select(*KEY, "block", F.array().cast("array<int>").alias("path"), "v")
    kind, kinds = F.expr("try_variant_get(v, '$.@type', 'string')"), F.expr("try_variant_get(v, '$.@type', 'array<variant>')")
    # A list of types may hold others than strings.
    named = F.exists(kinds, lambda k: F.coalesce(F.when(F.schema_of_variant(k) == "STRING", F.try_variant_get(k, "$", "string") == "JobPosting"), F.lit(False)))
    posting = F.when(F.schema_of_variant(F.expr("try_variant_get(v, '$.@type', 'variant')")) == "STRING", kind == "JobPosting").otherwise(named)
    found = []
    while not rows.isEmpty():
        found.append(rows.where(~_one("v") & F.coalesce(posting, F.lit(False))).select(*KEY, "block", "path", F.col("v").alias("object")))
        items = F.when(_one("v"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.expr("try_variant_get(v, '$.@graph', 'array<variant>')"))
        rows = rows.select(*KEY, "block", "path", F.posexplode(items).alias("i", "w")).select(*KEY, "block", F.concat("path", F.array("i")).alias("path"), F.col("w").alias("v"))
        rows = checkpointed(rows.where("v IS NOT NULL"))
    none = read.where(F.lit(False)).select(*KEY, "block", F.array().cast("array<int>").alias("path"), F.col("v").alias("object"))
    return reduce(DataFrame.unionAll, found, none), rejects


def _value(path: str) -> Column:
    """A cleaned string or number at a path."""
    at = F.expr(f"try_variant_get(object, '{path}', 'variant')")
    return F.when(F.schema_of_variant(at).rlike("^(STRING|BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"), presence(clean(F.try_variant_get(at, "$", "string"))))


def _said(v: Column) -> Column:
    """A cleaned string or number of a variant, else null."""
    return F.when(F.schema_of_variant(v).rlike("^(STRING|BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"), presence(clean(F.try_variant_get(v, "$", "string"))))


def _first_string(path: str) -> Column:
    """The value at a path, or the first of a list there that is a string or number."""
    items = F.transform(F.expr(f"try_variant_get(object, '{path}', 'array<variant>')"), _said)
    return F.coalesce(F.get(F.array_compact(items), F.lit(0)), _value(path))


def _place(v: Column) -> Column:
    """A place: a string, the parts of its address or of itself, or its name."""
    part = lambda root, k: _said(F.try_variant_get(v, f"{root}.{k}", "variant"))
    keys = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")
    lines = (presence(F.array_join(F.array_compact(F.array(*(part(root, k) for k in keys))), ", ")) for root in ("$.address", "$"))
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", _said(v)), *lines, part("$", "name"))


def _places(path: str) -> Column:
    """A place, or all of a list, joined."""
    many = F.transform(F.expr(f"try_variant_get(object, '{path}', 'array<variant>')"), _place)
    return F.coalesce(presence(F.array_join(F.array_compact(many), "; ")), _place(F.expr(f"try_variant_get(object, '{path}', 'variant')")))


def job_postings(pages: DataFrame) -> DataFrame:
    """Decoded JobPosting objects of pages; valid is false where required fields are missing."""
    tree, n = held_tree(page_tree(_with_page(pages)))
    return _decoded_postings(_with_page(pages), canonical_links(tree), json_ld(tree)[0], n)


def _with_page(pages: DataFrame) -> DataFrame:
    return pages if "page" in pages.columns else pages.withColumn("page", F.xxhash64("html", "company"))


def _salary() -> Column:
    """baseSalary as JSON, if it is there."""
    return F.expr("CASE WHEN try_variant_get(object, '$.baseSalary', 'variant') IS NOT NULL THEN to_json(try_variant_get(object, '$.baseSalary', 'variant')) END")


def _decoded_postings(pages: DataFrame, canonical: DataFrame, objects: DataFrame, n: int) -> DataFrame:
    """objects as postings in n tasks, with evidence for title, company and URL."""
    about = pages.select(*KEY, "company").repartition(n, *KEY).distinct().join(canonical, KEY, "left")
    return objects.repartition(n, *KEY).join(about, KEY).withColumns(held("posting URLs", _posting_urls)).select(*held("posting", _posting_columns)).withColumn("valid", F.col("title").isNotNull() & F.col("company").isNotNull() & (F.col("description").isNotNull() | F.col("application_url").isNotNull()))


def _posting_urls() -> dict[str, Column]:
    link = lambda path: resolve(_value(path), F.col("url"))
    organization = F.coalesce(_value("$.hiringOrganization.name"), _value("$.hiringOrganization"))
    return {"organization": organization, "own": link("$.url"), "entity": F.coalesce(link("$.mainEntityOfPage"), link("$.mainEntityOfPage.@id"), link("$.mainEntityOfPage.url")), "application_url": link("$.applicationUrl")}


def _proof(field: str, source: Column, confidence: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), source.alias("source"), confidence.alias("confidence"))


def _posting_columns() -> list[Column]:
    by = F.when(F.col("own").isNotNull(), "json-ld.url").when(F.col("entity").isNotNull(), "json-ld.mainEntityOfPage").when(F.col("canonical").isNotNull(), "html-canonical").otherwise("final-url")
    evidence = F.array(_proof("title", F.lit("json-ld.title"), F.lit(1.0)), _proof("company", F.when(F.col("organization").isNull(), "configured-company").otherwise("json-ld.hiringOrganization"), F.lit(0.95)), _proof("canonicalUrl", by, F.lit(0.95)))
    direct = F.expr("try_variant_get(object, '$.directApply', 'variant')")
    return [
        *map(F.col, KEY), F.col("block"), F.col("path"), _value("$.title").alias("title"), F.coalesce("organization", presence(clean(F.col("company")))).alias("company"), _value("$.description").alias("description"), F.col("application_url"),
        F.coalesce("own", "entity", "canonical", "url").alias("canonical_url"), F.coalesce(_value("$.identifier"), _value("$.identifier.value"), _value("$.identifier.name")).alias("external_id"), _first_string("$.employmentType").alias("employment_type"),
        F.coalesce(_places("$.jobLocation"), _places("$.applicantLocationRequirements")).alias("location_text"), _value("$.jobLocationType").alias("workplace_type"),
        iso_timestamp(_value("$.datePosted")).alias("published_at"), iso_timestamp(_value("$.validThrough")).alias("expires_at"), F.lit("json-ld").alias("strategy"), F.lit(0.95).alias("confidence"), evidence.alias("evidence"),
        F.when(direct.isNotNull(), F.coalesce(F.schema_of_variant(direct) == "BOOLEAN", F.lit(False)) & F.coalesce(F.try_variant_get(direct, "$", "boolean"), F.lit(False))).alias("direct_apply"),
        _value("$.industry").alias("industry"), _value("$.occupationalCategory").alias("occupational_category"), _salary().alias("base_salary"),
    ]


# -- what a page shows


def anchors(tree: DataFrame) -> DataFrame:
    """(url, page, pos, href, text, offered): anchors with a target; offered: in an area of
    job links, or marked as an item's URL."""
    offered = (F.col("in_area") - has_class("job").cast("int") > 0) | is_item("url")
    wanted = (F.col("name") == "a") & attribute("href").isNotNull()
    here = beside_texts(tree, wanted, ["pos", "idx", "last", attribute("href").alias("href"), offered.alias("offered")]).withColumn("inner", inner())
    return here.select(*KEY, "pos", "href", "offered", held("clean inner", lambda: clean(F.col("inner"))).alias("text"))


def job_links(found: DataFrame, maximum: int) -> DataFrame:
    """(url, page, link, reason, pos): job-like links among anchors in first-seen order, maximum a page."""
    rows = found.where(F.col("offered") & ~F.col("href").rlike(EXCLUDED_LINK) & ~F.col("text").rlike(EXCLUDED_LINK) & ~F.col("text").rlike(APPLY_TEXT)).withColumn("link", resolved("href"))
    path = F.regexp_extract("link", r"^[a-z]+://[^/]*([^?#]*)", 1)
    rows = rows.withColumn("path", path).where((F.col("link") != F.col("url")) & ~F.col("path").rlike("(?i)/apply(?:/|$)") & (F.col("path").rlike(JOB_PATH) | F.col("text").rlike(JOB_TEXT)))
    first = rows.groupBy(*KEY, "link").agg(F.min("pos").alias("pos"), F.any_value("path").alias("path"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy("pos"))).where(F.col("n") <= maximum)
    return ranked.select(*KEY, "link", F.when(F.col("path").rlike(JOB_PATH), "job-like-path").otherwise("job-like-anchor-text").alias("reason"), "pos")


def links(pages: DataFrame, maximum: int = 50) -> DataFrame:
    """(url, link, reason, pos): job-like links of a page in first-seen order, maximum at most."""
    company = pages if "company" in pages.columns else pages.withColumn("company", F.lit(None).cast("string"))
    return job_links(anchors(page_tree(_with_page(company))), maximum).drop("page")


def semantic_jobs(pages: DataFrame) -> DataFrame:
    """A posting from a page's heading and content, with its confidence and evidence."""
    tree, n = held_tree(page_tree(_with_page(pages)))
    return _semantic(_with_page(pages).select(*KEY, "company").repartition(n, *KEY), tree, anchors(tree), canonical_links(tree), n)


def _semantic(pages: DataFrame, tree: DataFrame, found: DataFrame, canonical: DataFrame, n: int) -> DataFrame:
    name = F.col("name")
    e = tree.where("name IS NOT NULL").withColumns({"prop": attribute("itemprop"), "of": F.when(name == "meta", attribute("property")), "when": attribute("datetime")})
    prop = lambda p: F.coalesce(F.col("prop") == p, F.lit(False))
    id_ = F.coalesce(F.lower(attribute("id")).contains("job-description"), F.lit(False))
    wanted = {
        "title": prop("title") | (name == "h1"), "organization": prop("hiringOrganization"), "site": prop("hiringOrganization") | F.coalesce(F.col("of") == "og:site_name", F.lit(False)),
        "content": prop("description") | has_class("job-description") | id_ | name.isin("article", "main"), "place": prop("jobLocation") | (name == "address"), "kind": prop("employmentType"),
        "date": prop("datePosted") | ((name == "time") & F.col("when").isNotNull()),
    }
    spot = F.struct("pos", "idx", "last", F.col("attrs.content").alias("content"), "when", "in_noise")
    first = e.groupBy(*KEY).agg(*(F.min(F.when(on, spot)).alias(k) for k, on in wanted.items()))
    texts = first.select(*KEY, F.explode(F.array(*(F.struct(F.lit(k).alias("of"), F.col(f"{k}.pos").alias("pos"), F.col(f"{k}.idx").alias("idx"), F.col(f"{k}.last").alias("last")) for k in ("title", "organization", "place", "kind")))).alias("x")).select(*KEY, "x.*").where("pos IS NOT NULL")
    # Joined by page only, as all is dealt; from files, so that its sorts are over before the others begin.
    spoken = inner_texts(texts, tree, "of").select(*KEY, "of", held("inner said", lambda: presence(clean(F.col("inner")))).alias("inner"))
    spoken = checkpointed(spoken.groupBy(*KEY).pivot("of", ["title", "organization", "place", "kind"]).agg(F.first("inner"))).repartition(n, *KEY)
    boxes = first.where("content IS NOT NULL").select(*KEY, "content.pos", "content.idx", "content.last", "content.in_noise")
    body = block_text(boxes, tree, LINE_ENDS, "noise", MOST_DESCRIPTION).select(*KEY, F.col("text").alias("description"))
    labelled = labelled_values(tree, ["location", "employment type"]).groupBy(*KEY).pivot("label", ["location", "employment type"]).agg(F.first("value"))
    apply = found.where(F.col("text").rlike(APPLY_TEXT)).withColumn("link", resolved("href")).where("link IS NOT NULL").groupBy(*KEY).agg(F.min_by("link", "pos").alias("application_url"))
    site = first.select(*KEY, F.col("site.content").alias("site"), F.col("date.when").alias("date"))
    rows = pages.select(*KEY, "company").distinct()
    for part in (site, spoken, body, labelled, apply, canonical):
        rows = rows.join(part, KEY, "left")
    rows = rows.withColumn("named", held("organization named", lambda: presence(clean(F.when(F.col("site").isNotNull(), F.col("site")).otherwise(F.col("organization"))))))
    out = rows.select(*held("semantic posting", _semantic_columns))
    return out.where("title IS NOT NULL AND company IS NOT NULL AND (description IS NOT NULL OR application_url IS NOT NULL) AND confidence >= 0.65")


def browser_reason(html: Column, n_links: Column) -> Column:
    body = F.coalesce(inner_text(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?is)^.*?<body\b[^>]*>", "")), F.lit(""))
    scripts = html.rlike(r"(?is)<script\b[^>]*(?:\bsrc\s*=|type\s*=\s*[\"']module[\"'])")
    root = html.rlike(r"(?is)id\s*=\s*[\"'](?:root|app)[\"']|data-reactroot|data-v-app")
    return F.when(body.rlike("(?i)javascript (?:is )?required|enable javascript"), "javascript-required").when((n_links == 0) & scripts & (root | (F.length(body) < 300)), "client-rendered-app-shell")


def _semantic_columns() -> list[Column]:
    score = F.round(F.least(F.lit(1.0), 0.4 + F.when(F.col("description").isNotNull(), 0.25).otherwise(0.0) + F.when(F.col("named").isNotNull(), 0.2).otherwise(0.1) + F.when(F.col("application_url").isNotNull(), 0.15).otherwise(0.0)), 4)
    evidence = F.array_compact(F.array(
        _proof("title", F.lit("semantic-heading"), F.lit(0.8)), _proof("company", F.when(F.col("named").isNull(), "configured-company").otherwise("semantic-organization"), F.when(F.col("named").isNull(), 0.7).otherwise(0.8)),
        F.when(F.col("description").isNotNull(), _proof("description", F.lit("semantic-content-container"), F.lit(0.7))),
    ))
    return [
        *map(F.col, KEY), F.col("title"), F.coalesce("named", presence(clean(F.col("company")))).alias("company"), F.col("description"), F.col("application_url"), F.coalesce("canonical", "url").alias("canonical_url"), F.coalesce("location", "place").alias("location_text"),
        F.coalesce("employment type", "kind").alias("employment_type"), iso_timestamp(presence(clean(F.col("date")))).alias("published_at"), F.lit("semantic-html").alias("strategy"), score.alias("confidence"), evidence.alias("evidence"),
    ]


# -- a page's stages together

_POSTING = ["title", "company", "description", "application_url", "canonical_url", "external_id", "employment_type", "location_text", "workplace_type", "published_at", "expires_at", "strategy", "confidence", "evidence", "direct_apply", "industry", "occupational_category", "base_salary"]


@dataclass
class Extraction:
    """By (url, page): postings with their place on the page (nth), links, and one row a page
    with its state: blocked_reason, n_postings, n_links, browser_reason, messages
    (warnings in order) and detections (a known board's provider and host)."""

    postings: DataFrame
    links: DataFrame
    pages: DataFrame


def extract(pages: DataFrame, most_links: int = 50) -> Extraction:
    """What pages (url, html, company) hold. A blocked page has a warning and nothing else;
    headings are read only where neither JSON-LD nor links gave anything; a browser is asked
    for only where no posting was found. Repeated pages count once; a null html is an empty page."""
    pages = dealt(_with_page(pages).select(*KEY, "company", F.coalesce("html", F.lit("")).alias("html"))).groupBy(*KEY).agg(F.first("company").alias("company"), F.first("html").alias("html"))
    pages = checkpointed(pages.withColumn("blocked_reason", held("blocked html", lambda: blocked_reason(F.col("html")))))
    clear = pages.where("blocked_reason IS NULL")
    tree, n = held_tree(page_tree(clear))
    objects, rejects = json_ld(tree)
    canonical = checkpointed(canonical_links(tree))
    decoded = checkpointed(_decoded_postings(clear, canonical, objects, n))
    found = checkpointed(anchors(tree)).repartition(n, *KEY)
    linked = checkpointed(job_links(found, most_links))
    structured = decoded.where("valid")
    told = structured.select(*KEY).unionAll(linked.select(*KEY)).repartition(n, *KEY).distinct().withColumn("_told", F.lit(True))
    bare = checkpointed(clear.select(*KEY, "company").repartition(n, *KEY).join(told, KEY, "left").where("_told IS NULL").drop("_told"))
    shown = _semantic(bare.repartition(n, *KEY), tree.join(bare.select(*KEY), KEY), found.join(bare.select(*KEY), KEY), canonical, n)
    both = structured.repartition(n, *KEY).withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("block", "path"))).unionByName(shown.withColumn("nth", F.lit(1)), allowMissingColumns=True)
    postings = checkpointed(both.select(*KEY, "nth", *_POSTING))

    said = lambda order, url: F.struct(F.lit(order).alias("o"), F.col("nth").alias("nth"), F.col(url).alias("v"))
    named = [
        pages.where("blocked_reason IS NULL").select(*KEY, F.struct(F.lit(0).alias("o"), F.lit(0).alias("nth"), F.col("url").alias("v")).alias("x")), canonical.select(*KEY, F.struct(F.lit(1).alias("o"), F.lit(0).alias("nth"), F.col("canonical").alias("v")).alias("x")),
        postings.select(*KEY, F.explode(F.array(said(2, "canonical_url"), said(2, "application_url"))).alias("x")), linked.select(*KEY, F.struct(F.lit(3).alias("o"), F.col("pos").alias("nth"), F.col("link").alias("v")).alias("x")),
    ]
    hosts = reduce(DataFrame.unionAll, named).select(*KEY, F.col("x.o").alias("o"), F.col("x.nth").alias("nth"), ats_provider(F.col("x.v")).alias("provider"), host(F.col("x.v")).alias("host")).where("provider IS NOT NULL").repartition(n, *KEY)
    each = hosts.groupBy(*KEY, "provider").agg(F.min(F.struct("o", "nth")).alias("first"), F.max_by("host", F.struct("o", "nth")).alias("host"))
    detections = each.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "provider", "host"))), lambda x: F.struct(x["provider"].alias("provider"), x["host"].alias("host"))).alias("detections"))
    skipped = decoded.where("NOT valid").select(*KEY, F.lit(1).alias("stage"), "block", "path", F.lit("A malformed or incomplete JobPosting object was skipped.").alias("message"))
    warned = rejects.select(*KEY, F.lit(0).alias("stage"), "block", F.array().cast("array<int>").alias("path"), "message").unionAll(skipped)
    messages = warned.repartition(n, *KEY).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("stage", "block", "path", "message"))), lambda x: x["message"]).alias("messages"))
    all_ = max(1, pages.rdd.getNumPartitions())
    state = pages.repartition(all_, *KEY)
    counted = lambda rows, name: rows.select(*KEY).repartition(all_, *KEY).groupBy(*KEY).agg(F.count("*").alias(name))
    for part in (counted(postings, "n_postings"), counted(linked, "n_links"), messages.repartition(all_, *KEY), detections.repartition(all_, *KEY)):
        state = state.join(part, KEY, "left")
    state = state.withColumns({"n_postings": F.coalesce("n_postings", F.lit(0)), "n_links": F.coalesce("n_links", F.lit(0)), "detections": F.coalesce("detections", F.array().cast("array<struct<provider:string,host:string>>"))})
    stop = F.array(F.concat(F.lit("Blocked page detected: "), F.col("blocked_reason"), F.lit(".")))
    state = state.withColumn("messages", F.when(F.col("blocked_reason").isNotNull(), stop).otherwise(F.coalesce("messages", F.array().cast("array<string>"))))
    asked = held("browser asked", lambda: browser_reason(F.col("html"), F.col("n_links")))
    reason = F.when(F.col("blocked_reason").isNull() & (F.col("n_postings") == 0), asked)
    return Extraction(postings, linked, checkpointed(state.withColumn("browser_reason", reason).drop("html")))
