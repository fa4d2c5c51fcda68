"""The element tree of pages as a table: a row an element or text, met by windows and joins.

A page's markup is cut into tags and texts. Ends are found by windows over a page's
rows, never by a stack in one row: start and end tags of one name alternate at each
level of their own nesting, so an end tag is the next row of its level. Elements whose
end tags may be left out (p, li, dt, dd, table parts, option) end where, in the same
element of both tags, their end tag or one that ends them comes next, or with that
element; others without an end tag end with it or the next such tag. Running sums
over starts and ends then give depth and, for whatever is marked, how many marked
elements are around a row; the parent is the last row one level up.

Not HTML's whole algorithm: elements that overlap keep their own ends, nothing is
moved out of tables, no tags are invented.

nodes() has a row for each element and each text, by (url, page):

    pos, name      place in the page, and element name; null for text
    attrs, text    an element's attributes, and text, references decoded; script, style,
                   title and the like hold their text themselves
    last           texts inside an element have idx in (idx, last]; a text's is its idx
    idx            the number of texts before an element starts
    depth, parent  elements around it, and the pos of the innermost
    in_<mark>      marked elements around it, itself included

A repeated page (url and html equal) counts once; a null html has no rows. Where pages
have a column page, it tells them apart beside the url; else it is the html's hash.

All of it works on pages dealt out by (url, page) to as many tasks as their markup needs
(dealt()), so a task's sorts stay as small as they are however much there is; windows,
groups and joins by page keep to that and shuffle nothing again. Spark's own choice
joins partitions by the bytes of compressed html, of which a tree is many times more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, decode_entities, held, let, presence, unique_by
from ..scratch import checkpointed

#: Elements without content, with text only, and what starts end those whose end tags may be left out.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
RAW = ["script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"]
_ROWS = ["tr", "tbody", "thead", "tfoot"]
_BLOCKS = ["address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"]
ENDED_BY = {
    "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "option": ["option", "optgroup"], "optgroup": ["optgroup"], "p": [*_BLOCKS, "li", "dt", "dd", "td", "th", *_ROWS],
    "td": ["td", "th", *_ROWS], "th": ["td", "th", *_ROWS], "tr": _ROWS, "tbody": _ROWS[1:], "thead": _ROWS[1:], "tfoot": _ROWS[1:],
}
#: Beside their own end tags, what end tags end them.
ENDED_WITH = {"p": ["li", "dt", "dd", "td", "th", *_ROWS], "li": ["td", "th", *_ROWS], "dt": ["td", "th", *_ROWS], "dd": ["td", "th", *_ROWS], "td": _ROWS, "th": _ROWS, "tr": _ROWS[1:]}

_INSIDE = r"""[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+"""
_TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(RAW)})(?=[\s/>]){_INSIDE}>.*?(?:</\1(?=[\s/>])[^>]*>|\z)|</?[a-z]{_INSIDE}>|</?[a-z][^>]*>|<[!?/][^>]*>?|[^<]+|<"
_START = rf"(?is)^<[a-z]{_INSIDE}>"
_ATTRIBUTE = r"""(?is)([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""

KEY = ["url", "page"]

#: Bytes of markup a task has about, the least worth a task of its own, and what a tag counts for beside its characters.
SHARE, LEAST_SHARE, TAG = 16 * 2**20, 2**19, 512


def tasks_for(pages: DataFrame, *texts: str, tag: int = TAG) -> int:
    """How many tasks the markup of pages (or what else is in texts) is dealt to; tag 0 is for what becomes no tree."""

    def weight(text: str) -> Column:
        tags = F.length(text) - F.length(F.replace(F.col(text), F.lit("<"), F.lit(""))) if tag else F.lit(0)
        return F.coalesce(F.octet_length(text) + F.lit(tag).cast("long") * tags, F.lit(0).cast("long"))

    total = sum(pages.agg(*(F.sum(weight(x)) for x in texts or ("html",))).na.fill(0).first())
    return max(1, -(-total // SHARE), min(pages.sparkSession.sparkContext.defaultParallelism, total // LEAST_SHARE))


def dealt(pages: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """pages by their keys in tasks_for() partitions."""
    return pages.repartition(tasks_for(pages), *keys)


def held_tree(tree: DataFrame) -> tuple[DataFrame, int]:
    """A tree from checkpoint files, which whatever reads it deals out as it was, and its number of tasks.
    Some of its pages are taken by an inner join, as Spark moves a semi join below the dealing; and what
    it is joined to is dealt out so too if it was grouped, as Spark prefers a grouping's partitions."""
    kept = checkpointed(tree)
    n = max(1, kept.rdd.getNumPartitions())
    return kept.repartition(n, *KEY), n


def _attributes(tag: Column) -> Column:
    """Names (lower case) to decoded values of a start tag's attributes; the first of a name counts."""

    def found(t: Column) -> Column:
        part = lambda k: F.regexp_extract_all(t, F.lit(_ATTRIBUTE), F.lit(k))
        names = F.transform(part(1), F.lower)
        join = lambda a, b: F.concat(a, b)
        values = F.zip_with(F.zip_with(part(2), part(3), join), part(4), join)
        pairs = F.zip_with(names, F.transform(values, decode_entities), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
        return F.map_from_entries(unique_by(pairs, lambda e: e["k"]))

    none = F.create_map().cast("map<string,string>")
    return F.when(tag.rlike(r"^<[^\s/>]+[\s/]+[^\s/>]"), let(F.regexp_replace(tag, r"^<[^\s/>]+", ""), found)).otherwise(none)


def attribute(name: str) -> Column:
    """The value of an element's attribute ("" where it has none); null if it is absent."""
    return F.col("attrs")[name]


def has_class(part: str) -> Column:
    """Whether an element's class contains part, in any case; part is lower-case."""
    return F.coalesce(F.lower(attribute("class")).contains(part), F.lit(False))


def is_item(prop: str) -> Column:
    return F.coalesce(attribute("itemprop") == prop, F.lit(False))


def _tokens(pages: DataFrame) -> DataFrame:
    """(url, page, pos, name, move, raw, t): tags and texts; move is 1 for a start tag that needs an end, -1 for an end."""
    page = F.col("page") if "page" in pages.columns else F.xxhash64("html")
    once = dealt(pages.where("html IS NOT NULL").select("url", page.alias("page"), "html")).groupBy(*KEY).agg(F.first("html").alias("html"))
    t = once.select(*KEY, F.posexplode(F.regexp_extract_all("html", F.lit(_TOKEN), F.lit(0))).alias("pos", "t"))
    t = t.where(~F.col("t").rlike(r"^<(?:[!?]|/(?![A-Za-z]))"))
    t = t.withColumn("name", F.nullif(F.lower(F.regexp_extract("t", r"^</?([A-Za-z][^\s/>]*)", 1)), F.lit("")))
    ends, raw = F.col("t").startswith("</"), F.coalesce(F.col("name").isin(RAW), F.lit(False))
    t = t.withColumn("raw", raw & ~ends).where(~(ends & F.col("name").isin(RAW + VOID)))
    plain = F.col("name").isNotNull() & ~F.col("raw") & ~F.col("name").isin(VOID)
    return t.withColumn("move", F.when(plain, F.when(F.col("t").startswith("</"), -1).otherwise(1)).otherwise(0))


def _ended(tokens: DataFrame) -> DataFrame:
    """tokens with idx, and with (at, last) of where an element ends: the pos of the row
    before which it does, and the texts until there."""
    by = lambda *more: Window.partitionBy(*KEY, *more)
    text = F.col("name").isNull() | F.col("raw")
    t = tokens.withColumn("idx", F.sum(text.cast("int")).over(by().orderBy("pos")))
    # Levels of a name's own nesting; an end tag that goes below the least so far has no start.
    free = F.coalesce(F.col("name").isin(list(ENDED_BY)), F.lit(False))
    t = t.withColumn("free", free).withColumn("strict", F.when(free, 0).otherwise(F.col("move")))
    own = by("name").orderBy("pos")
    t = t.withColumn("c", F.sum("strict").over(own))
    t = t.withColumn("low", F.least(F.lit(0), F.coalesce(F.min("c").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    t = t.where(~((F.col("strict") == -1) & (F.col("c") < F.col("low"))))
    t = t.withColumn("level", F.when(F.col("strict") == 1, F.col("c") - F.col("low")).when(F.col("strict") == -1, F.col("c") - F.col("low") + 1))
    mate = F.lead(F.struct(F.col("pos").alias("at"), F.col("idx").alias("last"))).over(by("name", "level").orderBy("pos"))
    t = t.withColumn("mate", F.when(F.col("strict") == 1, mate))
    # Levels of all that have both tags. What follows on a row's level is in the same
    # element until that element's end tag, which is on that level too.
    step = F.when(F.col("mate").isNotNull(), 1).when(F.col("strict") == -1, -1).otherwise(0)
    t = t.withColumn("step", step).withColumn("d", F.sum("step").over(by().orderBy("pos")))
    t = t.withColumn("d", F.col("d") - F.when(F.col("step") == 1, 1).when(F.col("step") == -1, -1).otherwise(0))
    here = F.struct(F.col("pos").alias("at"), F.when(F.col("raw"), F.col("idx") - 1).otherwise(F.col("idx")).alias("last"))
    later = by("d").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    follow = lambda on: F.last(F.when(on, here), ignorenulls=True).over(later)
    ends = F.col("move") == -1
    starts = F.col("name").isNotNull() & ~ends
    groups = {tuple(v): [k for k in ENDED_BY if ENDED_BY[k] == v] for v in ENDED_BY.values()}
    next_ = {f"s{i}": follow(starts & F.col("name").isin(list(enders))) for i, enders in enumerate(groups)} | {f"e{i}": follow(ends & F.col("name").isin(k, *ENDED_WITH.get(k, []))) for i, k in enumerate(ENDED_BY)}
    t = t.withColumns({"outer": follow(F.col("strict") == -1), "any": follow(F.col("free")), **next_})
    sibling = F.coalesce(*(F.when(F.col("name").isin(names), F.col(f"s{i}")) for i, names in enumerate(groups.values())))
    own_tag = F.coalesce(*(F.when(F.col("name") == k, F.col(f"e{i}")) for i, k in enumerate(ENDED_BY)))
    # least() takes the first place and passes over nulls.
    open_end = F.when(F.col("free"), F.least("outer", sibling, own_tag)).otherwise(F.least("outer", "any"))
    own_end = F.struct(F.col("pos").alias("at"), F.col("idx").alias("last"))
    page_end = F.struct(F.lit(2**31 - 1).alias("at"), F.max("idx").over(by()).alias("last"))
    end = F.when(F.col("move") == 1, F.coalesce("mate", open_end, page_end)).when(F.col("move") == 0, own_end)
    t = t.withColumn("end", end).where(F.col("move") >= 0)
    return t.select(*KEY, "pos", "name", "raw", "move", "t", F.when(F.col("raw"), F.col("idx") - 1).otherwise(F.col("idx")).alias("idx"), F.col("end.at").alias("at"), F.col("end.last").alias("last"))


def nodes(pages: DataFrame, marks: dict[str, Column] | None = None) -> DataFrame:
    """The element tree of pages (url, html); marks are conditions over name and attrs."""
    marks = marks or {}
    t = _ended(_tokens(pages))
    element = F.col("name").isNotNull()
    raw = F.regexp_replace(F.regexp_replace("t", _START, ""), r"(?is)</[a-z]+[^>]*>\z", "")
    code = F.coalesce(F.col("name").isin("script", "style"), F.lit(False))
    text = held("element text", lambda: let(F.when(~element, F.col("t")).when(F.col("raw"), raw), lambda x: F.when(code, x).otherwise(decode_entities(x))))
    attrs = held("element attributes", lambda: F.when(element, _attributes(F.regexp_extract("t", _START, 0))))
    t = t.withColumns({"attrs": attrs, "text": text}).drop("t")
    t = t.withColumns({f"in_{k}": F.coalesce(element & on, F.lit(False)).cast("int") for k, on in marks.items()})
    # An element starts at its place and ends between two; ends come first where both are.
    place, end = F.col("pos") * F.lit(2).cast("long"), F.when(F.col("move") == 1, F.col("at").cast("long") * 2).otherwise(F.col("pos") * F.lit(2).cast("long") + 1)
    # A text ends nothing: its one event changes nothing.
    t = t.withColumn("e", F.explode(F.when(element, F.array(F.struct(place.alias("p"), F.lit(1).alias("s")), F.struct(end.alias("p"), F.lit(-1).alias("s")))).otherwise(F.array(F.struct(place.alias("p"), F.lit(0).alias("s"))))))
    flow = Window.partitionBy(*KEY).orderBy("e.p", "e.s", "pos")
    t = t.withColumns({"depth": F.sum("e.s").over(flow) - (F.col("e.s") == 1).cast("int"), **{f"in_{k}": F.sum(F.col(f"in_{k}") * F.col("e.s")).over(flow) for k in marks}}).where("e.s >= 0")
    # Each element stands once on its own level and, as the parent to come, on the next.
    both = F.when(element, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    t = t.withColumn("under", F.explode(both)).withColumn("depth", F.col("depth") + F.col("under"))
    level = Window.partitionBy(*KEY, "depth").orderBy("pos")
    t = t.withColumn("parent", F.last(F.when(F.col("under") == 1, F.col("pos")), ignorenulls=True).over(level)).where("under = 0")
    return t.select(*KEY, "pos", "name", "attrs", "text", "idx", "last", F.col("depth").cast("int").alias("depth"), "parent", *(F.col(f"in_{k}").cast("int").alias(f"in_{k}") for k in marks))


def beside_texts(tree: DataFrame, wanted: Column, columns: list[Column | str]) -> DataFrame:
    """(url, page, columns, texts): the rows of a tree that are wanted, each beside the list of its
    page's texts in order, of which inner() is a slice. Pages of null url are left out."""
    lists = tree.groupBy(*KEY).agg(F.collect_list(F.when(wanted, F.struct(*columns))).alias("_x"), _texts().alias("texts"))
    return lists.where("url IS NOT NULL").select(*KEY, "texts", F.explode("_x").alias("_x")).select(*KEY, "_x.*", "texts")


def _texts() -> Column:
    """The texts of a page, by aggregation."""
    pieces = F.collect_list(F.when(F.col("text").isNotNull(), F.struct("last", "text")))
    return F.transform(F.array_sort(pieces), lambda x: x["text"])


def inner(idx: str = "idx", last: str = "last") -> Column:
    """All text inside an element, as it stands; of its page's texts."""
    n = F.greatest(F.col(last) - F.col(idx), F.lit(0))
    return F.array_join(F.slice("texts", (F.col(idx) + 1).cast("int"), n.cast("int")), "")


def inner_texts(some: DataFrame, tree: DataFrame, *columns: str) -> DataFrame:
    """(url, page, pos, columns, inner): all text inside the elements `some` of a tree, as it stands, beside columns of some."""
    texts = tree.groupBy(*KEY).agg(_texts().alias("texts"))
    return some.select(*KEY, "pos", *columns, "idx", "last").join(texts, KEY, "left").select(*KEY, "pos", *columns, F.coalesce(inner(), F.lit("")).alias("inner"))


def labelled_values(tree: DataFrame, labels: list[str]) -> DataFrame:
    """(url, page, label, value): the text of the element after the first dt, th, strong or b
    that says the label (a colon at its end aside), of those that have any."""
    element = F.col("name").isNotNull()
    next_ = F.lead(F.struct("idx", "last")).over(Window.partitionBy(*KEY, "parent", element).orderBy("pos"))
    followed = tree.select(*KEY, "pos", "name", "text", "idx", "last", next_.alias("next"))
    is_head = F.col("name").isin("dt", "th", "strong", "b") & F.col("next").isNotNull()
    heads = beside_texts(followed, is_head, ["pos", "idx", "last", F.col("next.idx").alias("next_idx"), F.col("next.last").alias("next_last")])
    label = held("inner label", lambda: F.regexp_replace(F.lower(clean(F.col("inner"))), ":$", ""))
    said = heads.withColumn("inner", inner()).withColumn("label", label).where(F.col("label").isin(labels)).withColumn("inner", inner("next_idx", "next_last"))
    values = said.select(*KEY, "label", "pos", held("inner said", lambda: presence(clean(F.col("inner")))).alias("value")).where("value IS NOT NULL")
    return values.groupBy(*KEY, "label").agg(F.min_by("value", "pos").alias("value"))


def block_text(containers: DataFrame, tree: DataFrame, breaks: list[str], mark: str, most: int) -> DataFrame:
    """(url, page, pos, text): the lines of text inside containers (rows of a tree), without
    what is inside elements of the mark; a line ends with each element named in breaks."""
    box = containers.select(*KEY, F.col("pos").alias("box"), F.col("idx").alias("low"), F.col("last").alias("high"), F.col(f"in_{mark}").alias("around"))
    # A break stands after the last text of its element; one of no text, after the text before it.
    parts = tree.withColumn("piece", F.when(F.col("name").isin(breaks), F.lit("\n")).otherwise(F.col("text"))).where("piece IS NOT NULL").select(*KEY, F.col("pos").alias("at"), F.col("last").alias("i"), F.col("name").isin(breaks).alias("ends"), "piece", F.col(f"in_{mark}").alias("hidden"))
    inside = box.join(parts, KEY).where((F.col("hidden") <= F.col("around")) & (F.col("at") > F.col("box")) & (F.col("i") <= F.col("high")) & ((F.col("i") > F.col("low")) | F.col("ends")))
    lines = F.split(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("ends", F.lit(False)).alias("ends"), "at", "piece"))), lambda x: x["piece"]), ""), "\r", ""), "\n")
    text = inside.groupBy(*KEY, F.col("box").alias("pos")).agg(lines.alias("lines"))
    kept = F.filter(F.transform("lines", clean), lambda x: x != "")
    return text.select(*KEY, "pos", presence(F.left(F.array_join(kept, "\n"), F.lit(most))).alias("text"))
