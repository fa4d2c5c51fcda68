"""Public URLs as Column expressions: parse, check, canonicalise.

The parts of the WHATWG rules that job URLs meet: lower-case scheme and host,
default port dropped, dot segments resolved, fragment dropped, tracking parameters
removed, parameters sorted by name and encoded anew.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, let, nfkc

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):[/\\]*(?:([^/?#\\]*)@)?(\[[0-9A-Fa-f:.]+\]|[^/?#\\:@]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"
LOOPBACK = ("localhost", "127.0.0.1", "[::1]")


def _query(query: Column, removed: list[str]) -> Column:
    """name=value pairs without removed names, stably sorted, in form encoding."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    named = F.transform(pairs, lambda p, i: F.named_struct(F.lit("k"), decode(F.substring_index(p, "=", 1)), F.lit("i"), i, F.lit("v"), F.when(p.contains("="), decode(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise("")))
    kept = F.filter(named, lambda x: ~x["k"].isin(removed)) if removed else named
    return F.array_join(F.transform(F.array_sort(kept), lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&")


def normalize_url(url: Column, removed: list[str] | tuple[str, ...] = (), strip_slash: bool = False, sort: bool = False) -> Column:
    """struct<value, code>: the canonical URL, or why there is none (INVALID_URL,
    HTTPS_REQUIRED, CREDENTIALS_NOT_ALLOWED)."""
    trimmed = F.regexp_replace(F.regexp_replace(nfkc(url), f"^[{SPACE}]+|[{SPACE}]+$", ""), r"[\t\n\r]", "")
    names = ("scheme", "user", "host", "port", "path", "query")
    parts = let(trimmed, lambda x: F.named_struct(F.lit("whole"), x.rlike(_PARTS), *(y for k, n in enumerate(names) for y in (F.lit(n), F.regexp_extract(x, _PARTS, k + 1)))))
    return let(parts, lambda p: _assemble(url, p, list(removed), strip_slash, sort))


def host_of(url: Column) -> Column:
    """struct<scheme, user, host> of a URL, in lower case but for the user; nulls if it is none."""
    part = lambda k: F.when(url.rlike(_PARTS), F.regexp_extract(url, _PARTS, k))
    return F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("user"), F.lower(part(3)).alias("host"))


def _path(path: Column, strip_slash: bool) -> Column:
    """The path with its dot segments resolved, however many: a stack over the segments that
    come from the end, of which only the number of segments still to be left out is kept."""
    path = F.replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(?i)%2e", "."), F.lit(" "), F.lit("%20"))
    path = let(path, lambda x: F.when(x.rlike(r"/\.\.?(?:/|$)"), _without_dots(x)).otherwise(x))
    if strip_slash:
        path = F.regexp_replace(path, "/+$", "")
    return let(path, lambda x: F.when(x == "", "/").otherwise(x))


def _without_dots(path: Column) -> Column:
    """/a/./b/../c as /a/c; one that ends in dots keeps its slash."""
    segments = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    state = F.struct(F.lit(0).alias("skip"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        drop = (x == ".") | (x == "..") | (s["skip"] > 0)
        skip = F.when(x == "..", s["skip"] + 1).when((x != ".") & (s["skip"] > 0), s["skip"] - 1).otherwise(s["skip"])
        return F.struct(skip.alias("skip"), F.when(drop, s["out"]).otherwise(F.concat(F.lit("/"), x, s["out"])).alias("out"))

    end = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    # Dots at the end leave an empty last segment, which is no segment to be left out by them.
    return F.concat(F.aggregate(F.reverse(segments), state, step, lambda s: s["out"]), end)


def _assemble(url: Column, p: Column, removed: list[str], strip_slash: bool, sort: bool) -> Column:
    scheme, host, number = F.lower(p["scheme"]), F.lower(p["host"]), p["port"].try_cast("int")
    default = F.when(scheme == "https", "443").when(scheme == "http", "80")
    port = F.when((p["port"] == "") | (p["port"] == default), "").otherwise(F.concat(F.lit(":"), F.coalesce(number.cast("string"), p["port"])))
    query = let(_query(p["query"], removed) if sort else p["query"], lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    bad_host = scheme.isin("http", "https") & ((host == "") | host.rlike(r"[\x00-\x20<>^|%\[\]]") & ~host.startswith("["))
    bad_port = (p["port"] != "") & (F.coalesce(number, F.lit(99999)) > 65535)
    code = (
        F.when(url.isNull() | (F.length(url) > 10_000) | ~p["whole"] | bad_host | bad_port, "INVALID_URL")
        .when(~((scheme == "https") | (scheme == "http") & host.isin(*LOOPBACK)), "HTTPS_REQUIRED")
        .when(F.regexp_replace(p["user"], ":", "") != "", "CREDENTIALS_NOT_ALLOWED")
    )
    value = F.concat(scheme, F.lit("://"), host, port, _path(p["path"], strip_slash), query)
    return let(code, lambda c: F.named_struct(F.lit("value"), F.when(c.isNull(), value), F.lit("code"), c))
