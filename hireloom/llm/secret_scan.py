"""Secret scans with multipart credential linking, in DataFrame functions alone.

Strong kinds (assigned secrets, access identifiers, long hex runs) are always
reported. Weak parts (account identifiers, unlabelled tokens, endpoints) are
only reported where parts that complete each other lie within one scope: the
parts of a text are intervals, and two parts meet if they don't overlap and the
gap from the end of one to the start of the other is at most ``scope`` code points,
however long they are; a string is never its own complement. The interval join is
a sweep: ends and starts of all parts are events in order of place. At a part's
start the last end of each role so far is the nearest before it, at its end the
next start of each role the nearest after it. Places are running sums over a text's matches as rows, so a
text full of parts costs its length and never its square.

Spans are code points, end exclusive. A null text is an empty one; an empty
text has no spans. Repeated rows get equal results, whatever their ids. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table, wide_hash

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short can't hold a later match that is long enough, so the
#: least length can be asked for in these two patterns.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
STRONG = ("assign", "access", "hex")

#: Kind, pattern, role. An unlabelled token mixes digits with both cases of letters.
WEAK = (
    ("weak_id", r"""(?i:client_?id|access_?key_?id|account(?:_?id)?|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", "id"),
    ("weak_secret", r"""(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z])[A-Za-z0-9+/_=-]{16,}|(?<![0-9A-Za-z])[0-9a-f]{16,23}(?![0-9A-Za-z])""", "secret"),
    ("endpoint", r"""https?://[^\s"'<>]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]{2,5})?""", "endpoint"),
)
ROLE = {"assign": "secret", "access": "id", "hex": "secret"} | {k: role for k, _, role in WEAK}
ORDER = [*STRONG, *(k for k, _, _ in WEAK)]
SPAN = "array<struct<start:int,rank:int,end:int>>"


def lengths(text: Column, pattern: str, least: tuple[int, int] | None = None) -> Column:
    """All leftmost non-overlapping matches in order, as array<struct<gap, hit, kept>>: the
    lengths of what stands before a match and of itself. least: a group and the length it needs."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(least[0])) if least else found
    rows = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), part.alias("part"))
    sized = F.transform(rows, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), (F.length(x["part"]) >= (least[1] if least else 1)).alias("kept")))
    return F.when(text.rlike(pattern), sized).otherwise(F.array().cast("array<struct<gap:int,hit:int,kept:boolean>>"))


def places(matches: DataFrame) -> DataFrame:
    """(_hl_key, s): spans of the matches (_hl_key, and lengths() under the names of ORDER), a row each."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.col(k).alias("m")) for i, k in enumerate(ORDER))))
    rows = matches.select("_hl_key", each.alias("x")).where(F.size("x.m") > 0).select("_hl_key", F.col("x.rank").alias("rank"), F.posexplode("x.m").alias("nth", "m"))
    end = F.sum(F.col("m.gap") + F.col("m.hit")).over(Window.partitionBy("_hl_key", "rank").orderBy("nth")).cast("int")
    rows = rows.withColumn("end", end).where("m.kept")
    return rows.select("_hl_key", F.struct((F.col("end") - F.col("m.hit")).alias("start"), "rank", "end").alias("s"))


def render(spans: Column) -> Column:
    """kind:start:end by start, then kind in the order of ORDER, joined by commas."""
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """(id_col, n_chars, base, spans): base has the strong spans, spans also the weak
    ones that are confirmed within scope code points.

    A weak secret needs an identifier, a weak identifier a secret, an endpoint both.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    strong = {"assign": (ASSIGN, (2, 6)), "access": (ACCESS, None), "hex": (HEX, None)}
    rows = docs.select(
        F.col(id_col).alias(id_col), wide_hash(text).alias("_hl_key"), F.length(text).alias("n_chars"),
        *(lengths(text, p, least).alias(k) for k, (p, least) in strong.items()),
        *(lengths(text, p).alias(k) for k, p, _ in WEAK),
    )
    rows = saved(rows, "matches")
    # Equal texts are looked at once.
    some = F.greatest(*(F.size(k) for k in ORDER)) > 0
    found = saved(places(rows.where(some).groupBy("_hl_key").agg(*(F.first(k).alias(k) for k in ORDER))), "spans")

    weak_keys = found.where(F.col("s.rank") >= len(STRONG)).select("_hl_key").distinct()
    parts = found.join(weak_keys, "_hl_key", "left_semi")
    role = F.get(F.array(*(F.lit(ROLE[k]) for k in ORDER)), F.col("s.rank"))
    event = lambda name, is_start: F.struct(F.col(f"s.{name}").alias("at"), F.lit(is_start).alias("is_start"))
    events = parts.select("_hl_key", "s", role.alias("role"), F.explode(F.array(event("end", 0), event("start", 1))).alias("e")).select("_hl_key", "s", "role", "e.at", "e.is_start")
    # ends before starts at one place: parts that touch meet
    until = Window.partitionBy("_hl_key").orderBy("at", "is_start").rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy("_hl_key").orderBy(F.desc("at"), F.desc("is_start")).rowsBetween(Window.unboundedPreceding, 0)
    end = lambda r: F.max(F.when((F.col("role") == r) & (F.col("is_start") == 0), F.col("at"))).over(until)
    start = lambda r: F.min(F.when((F.col("role") == r) & (F.col("is_start") == 1), F.col("at"))).over(since)
    near = lambda r: F.when(F.col("is_start") == 1, F.col("at") - end(r) <= scope).otherwise(start(r) - F.col("at") <= scope)
    met = events.select("_hl_key", "s", "role", *(F.coalesce(near(r), F.lit(False)).alias(f"has_{r}") for r in ("id", "secret")))
    met = met.groupBy("_hl_key", "s", "role").agg(*(F.bool_or(f"has_{r}").alias(f"has_{r}") for r in ("id", "secret")))
    needs = {"id": F.col("has_secret"), "secret": F.col("has_id"), "endpoint": F.col("has_id") & F.col("has_secret")}
    weak = met.where((F.col("s.rank") >= len(STRONG)) & F.coalesce(*(F.when(F.col("role") == r, c) for r, c in needs.items())))
    every = found.where(F.col("s.rank") < len(STRONG)).unionAll(weak.select("_hl_key", "s"))
    # The spans of one text; of a text without any there is no row.
    spans = every.groupBy("_hl_key").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    none = F.array().cast(SPAN)
    out = rows.select(id_col, "n_chars", "_hl_key").join(saved(spans, "sorted"), "_hl_key", "left").select(id_col, "n_chars", F.coalesce("spans", none).alias("spans"))
    return out.select(id_col, "n_chars", F.filter("spans", lambda s: s["rank"] < len(STRONG)).alias("base"), "spans")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == ORDER.index(k))).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in STRONG), F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))
