"""The query of WARC archives, column by column, and chains that break."""

import base64
import hashlib
from pathlib import Path

import pytest

from hireloom.llm import warc

INNER = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
HUGE = "WARC/1.1\r\nContent-Length: 99999999999999999999999\r\n\r\nx\r\n\r\n"
PAGES = [
    (1, "http://x/" + "u" * 70_000, "a long address"),
    (2, "http://x/ÅContent-Length: 5", "byte 0x85 before a field's name"),
    (3, "http://x/\nContent-Length: 7", "line ends in an address"),
    (4, "http://x/4", "same"), (5, None, "same"), (9, "http://x/9", "same"),
    (6, "http://x/6", None), (7, "http://x/7", ""),
    (8, "http://x/8", "é" + INNER * 40), (10, "http://x/10", INNER), (11, "http://x/11", INNER), (12, "http://x/12", HUGE * 3),
]


def wanted(pages):
    for i, _, html in pages:
        raw = (html or "").encode()
        best = max(k for k, _, h in pages if (h or "") == (html or ""))
        yield i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == best else "revisit", None if i == best else best


@pytest.mark.parametrize("split", ["2000", "134217728"])
def test_query_columns(spark, tmp_path, split):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(2).write.parquet(f"{tmp_path}/pages.parquet")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.op2_warc_boundary_chain(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert sorted(tuple(r) for r in got) == sorted(wanted(PAGES))


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(None, "u", "a"), (None, "u", "b"), (3, "u", "a"), (3, "u", "a")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.op2_warc_boundary_chain(spark, str(tmp_path)).collect())
    assert got == [("3", "response", None), ("3", "response", None), ("None", "response", None), ("None", "revisit", 3)]


@pytest.mark.parametrize("damage", [lambda raw: raw[:-20], lambda raw: b"x" + raw, lambda raw: raw.replace(b"Content-Length: 6", b"Content-Length: 5", 1)])
def test_broken_chains_are_errors(spark, tmp_path, damage):
    path = f"{tmp_path}/warc"
    warc.write_warc(spark.createDataFrame([(k, "u", "text") for k in range(20)], "page_id long, url string, html string").coalesce(1), path)
    (part,) = Path(path).glob("part-*")
    part.write_bytes(damage(part.read_bytes()))
    for crc in Path(path).glob(".part-*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="no chain of records"):
        warc.read_warc(spark, path).count()
