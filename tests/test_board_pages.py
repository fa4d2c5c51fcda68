from hireloom.plans.queries import board_collection


def test_every_item_is_counted(spark, tmp_path):
    rows = [(k, "a" if k % 3 else "b", "en") for k in range(2500)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source_id: (r.raw_job_count, r.invalid_job_count, r.candidate_count) for r in board_collection(spark, str(tmp_path)).collect()}
    for source in "ab":
        own = [k for k, s, _ in rows if s == source]
        stored = {k % 400 for k in own if k % 7}
        assert got[source] == (len(own), len(own) - len(stored), len(stored))
