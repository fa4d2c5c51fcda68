"""WARC archives: a writer with revisit records and a reader by boundary chains.

Writing is Spark's text writer: a record's header, the blank line, its block and
the closing blank line are lines that end with CRLF CRLF, so each part file is a
valid uncompressed WARC/1.1 file. Of pages with equal payloads the one with the
largest id is written as a response, the others as revisit records that name it.

Reading splits files at any byte. Spark's text reader hands each task the
stretches between occurrences of the version line, whose offsets follow from
byte lengths: sums within a split, then sums over the splits of a file. Each
occurrence is a *candidate* record, and its Content-Length names its successor's
offset. A payload can hold the version line too, even a whole record; so only the
candidates that the chain from the file's start reaches are records. Reachability
is pointer jumping: every round doubles the length of the jumps, and the work is
spread over all candidates of all files. A record's block is its own stretch and
the false candidates' that follow it. A chain has to end where its file ends: if
one doesn't (a cut or damaged file), reading fails and names the file, as records
after the break can't be told from payloads.

Null payloads are empty ones. Repeated rows are written and read as they are;
rows that share the largest id are all responses. An empty table writes
no record and reads as an empty table. Columns other than the named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, saved, table

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: RFC 4648
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 as 32 base32 digits: each 5 hexadecimal digits are 4 of base 32."""
    sha = F.sha1(payload)
    digits = []
    for k in range(8):
        v = F.conv(F.substring(sha, 5 * k + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> None:
    """One record a row. Equal payloads of least_bytes and more share one response."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"), base32_sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    kinds = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.count("*").alias("copies"), F.max("id").alias("first"))
    total = rows.count()
    # a payload that is alone needs no look-up; this table is small where copies are few
    joined = _with_first(rows, saved(kinds.where("copies > 1"), "payloads"), total)
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:hireloom:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    field = lambda k, c: F.concat(F.lit(f"{k}: "), c, F.lit("\r\n"))
    safe = F.regexp_replace("url", r"[\r\n]+", " ")
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    head = F.concat(
        F.lit(MAGIC),
        field("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", name(F.col("id"))), field("WARC-Date", F.lit(date)), field("WARC-Target-URI", safe),
        F.when(again, F.concat(field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), field("WARC-Refers-To", name(F.col("first"))))).otherwise(F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), field("X-Payload-Length", F.col("n").cast("string")),
        field("Content-Type", F.lit("application/http; msgtype=response")), F.lit("Content-Length: "), F.octet_length(block).cast("string"),
    )
    joined.select(F.concat(head, F.lit(END), block).alias("value")).write.option("lineSep", END).text(path)


def _with_first(rows: DataFrame, many: DataFrame, total: int, share: int = 1000) -> DataFrame:
    """rows with the column first of their digest, null where the digest is alone.

    Digests with more than 1/share of all rows (share of them at most) come by
    broadcast, so a shuffled join has no hot key.
    """
    hot = many.where(F.col("copies") * share > total).select("digest", F.col("first").alias("_hl_hot"))
    rest = many.where(F.col("copies") * share <= total).select(F.col("digest").alias("_hl_key"), F.col("first").alias("_hl_rest"))
    first = rows.join(F.broadcast(hot), "digest", "left")
    # rows that have theirs are dealt out by their id
    key = F.when(F.col("_hl_hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    both = first.withColumn("_hl_key", key).join(rest, "_hl_key", "left")
    return both.withColumn("first", F.coalesce("_hl_hot", "_hl_rest")).drop("_hl_hot", "_hl_rest", "_hl_key")


def _stretches(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, value, head, length): what stands after each version line."""
    lines = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"),
    )
    rows = lines.withColumn("cut", _end("value")).withColumn("head", F.when(F.col("cut") > 0, F.decode(F.substring(F.col("value"), F.lit(1), F.col("cut") - 1), "ISO-8859-1"))).drop("cut")
    # lines end with CRLF alone; no file is as long as 16 digits say
    length = header("head", "Content-Length", "0*([0-9]{1,15})")
    return rows.withColumn("length", F.when(length != "", length.try_cast("bigint")))


def header(head: str, name: str, value: str) -> Column:
    """The group of value in a header field that is all of value; empty where there is none."""
    return F.regexp_extract(head, rf"(?:^|\r\n)(?i:{name}):[ \t]*{value}[ \t]*(?:\r\n|\z)", 1)


def _end(value: str) -> Column:
    """Where the first blank line of a binary value begins, from 1; 0 if there is none. The
    whole value is decoded only where its beginning has none."""
    at = lambda v: F.instr(F.decode(v, "ISO-8859-1"), END)
    early = at(F.substring(value, 1, 65536))
    return F.when((early > 0) | (F.octet_length(value) <= 65536), early).otherwise(at(F.col(value)))


def _payload(block: str) -> Column:
    """What follows the HTTP header of a block."""
    at = _end(block)
    return F.when(at > 0, F.substring(F.col(block), at + len(END), F.octet_length(block))).otherwise(F.col(block))


def _own(upto: Column | None = None) -> Column:
    """The bytes of a stretch after its header, upto so many."""
    size = F.octet_length("value")
    return F.substring(F.col("value"), F.length("head") + len(END) + 1, size if upto is None else F.least(upto, size.cast("bigint")).cast("int"))


def _chain(stretches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records, and the false candidates inside payloads, without payloads."""
    whole = F.coalesce(F.octet_length("value") >= F.length("head") + len(END) + F.col("length"), F.lit(False))
    block = F.when(whole, _own(F.col("length")))
    rows = stretches.withColumn("block", block).withColumn("payload", _payload("block"))
    slim = rows.select("file", "file_size", "split", "at", (F.octet_length("value") + len(MAGIC)).alias("size"), "head", "length", whole.alias("whole"), F.octet_length("payload").cast("long").alias("n_bytes"), base32_sha1(F.col("payload")).alias("digest"))
    slim = saved(slim, "candidates")

    # A version line stands where the stretches before it end.
    before = Window.unboundedPreceding, -1
    sums = slim.groupBy("file", "split").agg(F.sum("size").alias("bytes"))
    base = sums.select("file", "split", F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("split").rowsBetween(*before)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("file", "split").orderBy("at").rowsBetween(*before)), F.lit(0))
    placed = slim.withColumn("offset", within).join(base, ["file", "split"]).withColumn("offset", F.col("offset") + F.col("base") - len(MAGIC))
    successor = F.col("offset") + len(MAGIC) + F.length("head") + len(END) + F.col("length") + len(END)
    # what stands before the first version line of a file is no candidate
    placed = saved(placed.where("offset >= 0").withColumn("next", successor).drop("size", "base"), "placed")
    real = saved(reachable(placed), "reached")
    _check_ends(slim, placed, real)
    return placed.join(real, ["file", "offset"], "left_semi"), placed.join(real, ["file", "offset"], "left_anti")


def _check_ends(slim: DataFrame, placed: DataFrame, real: DataFrame) -> None:
    """Fail if a file's chain doesn't end at the file's end."""
    ends = placed.join(real, ["file", "offset"], "left_semi").groupBy("file").agg(F.max_by(F.coalesce("next", F.lit(-1)), "offset").alias("end"), F.max("offset").alias("last"))
    sizes = slim.groupBy("file").agg(F.max("file_size").alias("file_size"))
    broken = sizes.join(ends, "file", "left").where(~F.col("end").eqNullSafe(F.col("file_size"))).first()
    if broken:
        raise ValueError(f"{broken['file']}: no chain of records to the end of the file; the last record found is at {broken['last']}")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, head, n_bytes, digest, payload) of each record, in any order.

    n_bytes and digest are of the payload as read; where payload is not asked
    for, payloads without a version line inside are never shuffled.
    """
    stretches = _stretches(spark, path)
    real, false = _chain(stretches)
    real = saved(real, "records")
    # Records whose payload holds version lines: their own stretch and the false ones after it.
    torn = real.where("NOT whole")
    marks = torn.select("file", "offset", "split", "at", "length", F.col("offset").alias("owner")).unionByName(false.select("file", "offset", "split", "at", F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("bigint").alias("owner")))
    owner = F.last("owner", ignorenulls=True).over(Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0))
    marks = saved(marks.withColumn("mine", F.col("owner").isNotNull()).withColumn("owner", owner).where("owner IS NOT NULL"), "torn")
    parts = stretches.select("file", "split", "at", "value", "head").join(marks.select("file", "split", "at", "offset", "owner", "mine", F.col("length").alias("want")), ["file", "split", "at"])
    piece = F.when(F.col("mine"), F.hex(_own())).otherwise(F.concat(F.hex(F.lit(MAGIC)), F.hex("value")))
    joined = parts.groupBy("file", "owner").agg(F.max("want").alias("want"), F.array_sort(F.collect_list(F.struct("offset", piece.alias("piece")))).alias("p"))
    block = F.substring(F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")), F.lit(1), F.least(F.col("want"), F.lit(2**31 - 1)).cast("int"))
    mended = joined.select("file", F.col("owner").alias("offset"), block.alias("block")).withColumn("payload", _payload("block"))
    mended = torn.select("file", "offset", "head").join(mended.select("file", "offset", F.octet_length("payload").cast("long").alias("n_bytes"), base32_sha1(F.col("payload")).alias("digest"), "payload"), ["file", "offset"])

    plain = stretches.select("file", "split", "at", "value", "head", "length").withColumn("block", _own(F.col("length")))
    plain = plain.select("file", "split", "at", _payload("block").alias("payload"))
    good = real.where("whole")
    # a left join by a unique key: dropped by the optimizer where payload is not used
    good = good.join(plain.dropDuplicates(["file", "split", "at"]), ["file", "split", "at"], "left")
    cols = ["file", "offset", "head", "n_bytes", "digest", "payload"]
    return good.select(*cols).unionByName(mended.select(*cols))


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) of the candidates on the chain from offset 0, by pointer jumping.

    links has file, split, at, offset and next. Candidates of a split that follow
    each other are one segment, from its head to its exit; so a chain has about as
    many segments as the file has splits. Round k knows the segments within 2^k
    steps of the start, with the offset at which they are entered, and where 2^k
    steps lead from each; it ends when a round finds none.
    """
    order = Window.partitionBy("file", "split").orderBy("at")
    fresh = ~F.lag("next").over(order).eqNullSafe(F.col("offset"))
    marked = links.select("file", "split", "at", "offset", "next", fresh.cast("int").alias("fresh"))
    marked = marked.select("file", "offset", "next", F.max(F.when(F.col("fresh") == 1, F.col("offset"))).over(order).alias("head"))
    marked = saved(marked, "segments")
    exits = marked.groupBy("file", "head").agg(F.max_by("next", "offset").alias("entry")).where("entry IS NOT NULL")
    into = marked.select("file", F.col("offset").alias("entry"), F.col("head").alias("to"))
    jump = saved(exits.join(into, ["file", "entry"]), "jump")
    reached = marked.where("offset = 0").select("file", "head", F.col("offset").alias("entry"))
    n = reached.count()
    while True:
        found = jump.join(reached.select("file", "head"), ["file", "head"]).select("file", F.col("to").alias("head"), "entry")
        reached = saved(reached.unionAll(found).distinct(), "reached")
        if (m := reached.count()) == n:
            break
        n = m
        far = jump.select("file", F.col("head").alias("to"), F.col("to").alias("far"), F.col("entry").alias("far_entry"))
        jump = saved(jump.join(far, ["file", "to"]).select("file", "head", F.col("far").alias("to"), F.col("far_entry").alias("entry")), "jump")
    return marked.join(reached, ["file", "head"]).where(marked["offset"] >= reached["entry"]).select("file", "offset").distinct()


def op2_warc_boundary_chain(spark, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path)
    number = lambda name: F.nullif(header("head", name, "<urn:hireloom:page:(-?[0-9]*)>"), F.lit("")).cast("long")
    text = lambda name, value: header("head", name, value)
    kind = text("WARC-Type", "([a-z]+)")
    again = kind == "revisit"
    return records.select(
        number("WARC-Record-ID").alias("page_id"),
        F.when(again, text("X-Payload-Length", "([0-9]+)").cast("long")).otherwise(F.col("n_bytes")).alias("payload_bytes"),
        F.when(again, text("WARC-Payload-Digest", "sha1:([A-Z2-7]+)")).otherwise(F.col("digest")).alias("payload_digest"),
        kind.alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
    )
