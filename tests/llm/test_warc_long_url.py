from pyspark.sql import functions as F

from hireloom.llm import warc


def test_url_of_over_64_kb_between_others(spark):
    rows = [(1, "http://x/1", "one"), (2, "data:text/plain," + "x" * 70_000, "two"), (3, "http://x/3", "three"), (4, "data:," + "y" * 65_300, "four"), (5, "http://x/5", "five" * 30_000)]
    path = warc.new_folder(spark, "test")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = warc.read_warc(spark, path).select(F.regexp_extract("head", "page:([0-9]+)>", 1).cast("long").alias("id"), F.regexp_extract("head", "WARC-Target-URI: ([^\r\n]*)", 1).alias("url"), "payload").collect()
    assert sorted((r.id, r.url, bytes(r.payload).decode()) for r in got) == rows
