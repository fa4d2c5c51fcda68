"""The element table against a stack over the same tags, and what is read from it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hireloom.sources import elements
from hireloom.sources.elements import ENDED_BY, RAW, VOID, attribute, block_text, has_class, inner_texts, labelled_values, nodes
from hireloom.sources.pages import links, page_tree, semantic_jobs

PAGES = "url string, html string"


def model(html):
    """[(name or None, text inside, parent's place)] in document order by a stack."""
    out, stack = [], []

    def end(k):
        while len(stack) > k:
            stack.pop()

    for tag in re.findall(r"<[^>]*>|[^<]+", html):
        name = re.match(r"</?([a-z0-9]+)", tag)
        if not name:
            out.append([None, tag, stack[-1] if stack else None])
            for k in stack:
                out[k][1] += tag
            continue
        name = name[1]
        if tag.startswith("</"):
            at = [k for k in range(len(stack)) if out[stack[k]][0] == name]
            if at:
                end(at[-1])
            continue
        while stack and name in ENDED_BY.get(out[stack[-1]][0], ()):
            end(len(stack) - 1)
        out.append([name, "", stack[-1] if stack else None])
        if name not in VOID:
            stack.append(len(out) - 1)
    return [tuple(x) for x in out]


def random_html(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(["div", "section", "ul", "table", "p", "br", "text", "span", "dl"]) if depth < 4 else "text"
        left_out = rng.random() < 0.5
        inner = lambda: random_html(rng, depth + 1)
        line = lambda: f"w{rng.randrange(99)} " + rng.choice(["", "<b>x</b>", "<img>", "<a href=q>y</a>"])
        if kind == "text":
            out.append(line())
        elif kind == "br":
            out.append("<br>")
        elif kind == "p":
            out.append(f"<p>{line()}" + ("" if left_out else "</p>") + ("<p>z" if left_out else ""))
        elif kind == "ul":
            out.append("<ul>" + "".join(f"<li>{inner()}" + rng.choice(["", "</li>"]) for _ in range(rng.randrange(4))) + "</ul>")
        elif kind == "dl":
            out.append("<dl>" + "".join(f"<dt>{line()}" + rng.choice(["", "</dt>"]) + f"<dd>{inner()}" + rng.choice(["", "</dd>"]) for _ in range(rng.randrange(3))) + "</dl>")
        elif kind == "table":
            rows = "".join("<tr>" + "".join(f"<td>{inner()}" + rng.choice(["", "</td>"]) for _ in range(rng.randrange(3))) + rng.choice(["", "</tr>"]) for _ in range(rng.randrange(3)))
            out.append(f"<table>{rows}</table>")
        else:
            out.append(f"<{kind}>{inner()}</{kind}>")
    return "".join(out)


def test_trees_are_those_of_a_stack(spark):
    rng = random.Random(4)
    pages = {f"u{k}": random_html(rng) for k in range(60)}
    pages["mixed"] = "<ul><li>a</li><li>b<ul><li>c</ul></li><li>d</ul><p>e<div>f</div></div>g"
    pages["deep"] = "<div>" * 300 + "x" + "</div>" * 300
    rows = spark.createDataFrame([*pages.items(), *list(pages.items())[:3], ("none", None), ("empty", "")], PAGES)
    tree = nodes(rows).cache()
    text = {(r.url, r.pos): r.inner for r in inner_texts(tree.where("name IS NOT NULL"), tree).collect()}
    found = {}
    for r in tree.orderBy("url", "pos").collect():
        found.setdefault(r.url, []).append(r)
    for url, html in pages.items():
        got = found.get(url, [])
        place = {r.pos: k for k, r in enumerate(got)}
        mine = [(r.name, text[url, r.pos] if r.name else r.text, place.get(r.parent)) for r in got]
        assert mine == model(html), html
        assert all(r.depth == (0 if r.parent is None else got[place[r.parent]].depth + 1) for r in got)
    assert not {"none", "empty"} & set(found)
    tree.unpersist()


def test_markup_that_is_no_element(spark):
    html = """<!DOCTYPE html><!-- <b>no</b> --><title>a &amp; <b></title><script type="x">if (a<b) "</p>"</script><p title='1 > 0' CLASS="A  jobs&amp;b" hidden data-x=y/z title="second">x < y &lt; z<textarea><i></textarea>"""
    tree = nodes(spark.createDataFrame([("u", html)], PAGES), {"p": F.col("name") == "p"}).orderBy("pos").collect()
    assert [(r.name, r.text) for r in tree] == [("title", "a & <b>"), ("script", 'if (a<b) "</p>"'), ("p", None), (None, "x "), (None, "<"), (None, " y < z"), ("textarea", "<i>")]
    assert dict(tree[2].attrs) == {"title": "1 > 0", "class": "A  jobs&b", "hidden": "", "data-x": "y/z"}
    assert [r.in_p for r in tree] == [0, 0, 1, 1, 1, 1, 1] and tree[3].attrs is None
    assert set(RAW) >= {"script", "style", "textarea", "title"}


LIST = '<ul class="Open-Jobs"><li><a href="/jobs/1">Engineer</a></li><li class="job"><a class=job href="/x">Data <b>Analyst</b></a></li></ul>'


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<div>{LIST}</div>", ["/jobs/1", "/x"]),
        ('<div class="job"><div>a</div><span><a href="/jobs/2">y</a></span></div><a href="/jobs/3">outside</a>', ["/jobs/2"]),
        ('<a class="job" href="/jobs/4">itself</a><a itemprop="url" href="/jobs/5">marked</a>', ["/jobs/5"]),
        ('<main><a href="/jobs/2#a">Dev</a><a href="/jobs/2">Dev</a><a href="/privacy/jobs">x</a><a href="/jobs/2/apply">Go</a><a href="/jobs/7">Apply now</a><a>no target</a></main>', ["/jobs/2"]),
        ('<article><a href="/about">Role</a><a href="https://other.test/jobs/1">x</a><a href="https://jobs.lever.co/y">Engineer</a></article>', ["/about", "https://jobs.lever.co/y"]),
    ],
)
def test_links(spark, html, want):
    got = links(spark.createDataFrame([("https://s.test/", html)], PAGES)).orderBy("pos").collect()
    assert [r.link.removeprefix("https://s.test") for r in got] == want


def test_labelled_values_and_lines(spark):
    html = """<main><h1>T</h1><dl><dt>Location:</dt><dd>Rome</dd><dt>LOCATION<dd>Bern</dl><table><tr><th>Employment  Type<td>Full<br>time</table>
    <p><strong>Team</strong> <em>Data</em></p><b>empty</b><i></i><b>Empty</b><i>filled</i><p hidden>h</p><div class="x cookie-y">c</div><nav>n</nav><p>one<br>two<div>three <span aria-hidden=true>s</span>four</div></main>"""
    tree = page_tree(spark.createDataFrame([("u", html)], PAGES).withColumn("page", F.lit(1).cast("long"))).cache()
    got = {r.label: r.value for r in labelled_values(tree, ["location", "employment type", "team", "empty", "other"]).collect()}
    assert got == {"location": "Rome", "employment type": "Fulltime", "team": "Data", "empty": "filled"}
    text = block_text(tree.where("name = 'main'"), tree, ["br", "p", "li", "h1", "tr", "dt", "dd"], "noise", 500).first().text
    assert text == "T\nLocation:\nRome\nLOCATION\nBern\nEmployment TypeFull\ntime\nTeam Data\nemptyEmptyfilledone\ntwo\nthree four"
    assert [r.t for r in tree.where(has_class("cookie")).select(attribute("class").alias("t")).collect()] == ["x cookie-y"]
    tree.unpersist()


def test_semantic_posting(spark):
    html = """<link rel="x Canonical" href="/real#f"><meta property="og:site_name" content=" Org "><article><h1>Data <i>Engineer</i></h1><dl><dt>Employment type</dt><dd>full-time</dd></dl>
    <address>Main St 1</address><time datetime="2026-01-02T03:04:05Z">x</time><p>Do <div>this</div><div class="cookie">no</div></article><p><a href="#">apply</a><a href="http://x.test/">Apply</a><a href="/a">Apply now</a>"""
    r = semantic_jobs(spark.createDataFrame([("https://s.test/p", html, "Co")], "url string, html string, company string")).first()
    assert (r.title, r.company, r.canonical_url, r.location_text, r.employment_type, r.published_at, r.application_url, r.confidence) == ("Data Engineer", "Org", "https://s.test/real", "Main St 1", "full-time", "2026-01-02T03:04:05.000Z", "https://s.test/p", 1.0)
    assert r.description.split("\n")[0] == "Data Engineer" and "no" not in r.description.split("\n")[-1] and [e.source for e in r.evidence] == ["semantic-heading", "semantic-organization", "semantic-content-container"]


def test_trees_take_tasks_by_their_markup(spark, monkeypatch):
    """A task's pages stay few however many there are, also where Spark would join its partitions or
    the session has few (F1 to F5), and trees read again from files are dealt out as they were."""
    monkeypatch.setattr(elements, "SHARE", 2**16)
    html = "<main><dl>" + "<dt>Team<dd>x" * 200 + "</dl></main>"
    tree = nodes(spark.createDataFrame([(f"u{i}", html) for i in range(60)], PAGES))
    texts = elements.beside_texts(tree, F.col("name") == "dd", ["idx", "last"])
    again, n = elements.held_tree(tree)
    for rows in (texts, again.where("name = 'dd'"), again.groupBy(*elements.KEY).count()):
        a_task = [r.pages for r in rows.groupBy(F.spark_partition_id()).agg(F.count_distinct("url").alias("pages")).collect()]
        assert sum(a_task) == 60 and len(a_task) > 30 and max(a_task) < 8
    assert n == 60 * (len(html) + elements.TAG * html.count("<")) // 2**16 + 1
