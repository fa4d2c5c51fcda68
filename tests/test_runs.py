"""Runs: created, then completed, failed or cancelled; what fails is raised again."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from hireloom.operators import runs as R


def clock():
    n = iter(range(100))
    return lambda: f"2026-07-29T10:00:{next(n):02d}.000Z"


def rows(spark, path):
    return [(r.status, r.started_at, r.completed_at, r.counts) for r in R.runs(spark, path).orderBy("started_at").collect()]


def test_completed_and_failed(spark, tmp_path):
    path, tick = f"{tmp_path}/runs", clock()
    counts = {"considered_count": 3, "error_count": 0}
    got = R.execute(spark, path, lambda run: counts, "test", {"rules": "v1"}, tick)
    assert (got["status"], got["considered_count"], got["started_at"]) == (R.COMPLETED, 3, "2026-07-29T10:00:00.000Z")
    assert R.execute(spark, path, lambda run: {"considered_count": 3, "error_count": 1}, "test", clock=tick)["status"] == R.PARTIALLY_FAILED
    assert R.execute(spark, path, lambda run: {"considered_count": 3, "error_count": 3}, "test", clock=tick)["status"] == R.FAILED

    def listing_fails(run):
        run.counts["considered_count"] = 0
        open_row = R.runs(spark, path).where(F.col("run_id") == run.run_id).first()
        assert (open_row.status, open_row.completed_at) == (R.STARTED, None)
        raise ZeroDivisionError("synthetic listing failure")

    with pytest.raises(ZeroDivisionError, match="synthetic"):
        R.execute(spark, path, listing_fails, "test", clock=tick)
    got = rows(spark, path)
    assert [x[0] for x in got] == [R.COMPLETED, R.PARTIALLY_FAILED, R.FAILED, R.FAILED]
    assert got[0][1:] == ("2026-07-29T10:00:00.000Z", "2026-07-29T10:00:01.000Z", '{"considered_count": 3, "error_count": 0}') and got[3][3] == '{"considered_count": 0}'


def test_a_failure_to_close_hides_nothing(spark, tmp_path, monkeypatch):
    path, append, calls = f"{tmp_path}/runs", R._append, []

    def fails_second(*a):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("disk")
        append(*a)

    monkeypatch.setattr(R, "_append", fails_second)
    with pytest.raises(ZeroDivisionError):
        R.execute(spark, path, lambda run: 1 / 0, "test")
    assert [x[0] for x in rows(spark, path)] == [R.STARTED]


def test_cancelled_from_another_thread(spark, tmp_path):
    path = f"{tmp_path}/runs"

    def slow(run):
        run.counts["considered_count"] = 1
        spark.sql("SELECT sum(hash(a.id, b.id)) FROM range(0, 400000, 1, 8) a, range(0, 4000000, 1, 8) b").collect()  # far longer than the test waits
        return run.counts

    def stop(run):
        threading.Thread(target=lambda: (time.sleep(3), run.cancel()), daemon=True).start()

    began = time.time()
    with pytest.raises(R.Cancelled):
        R.execute(spark, path, slow, "test", on_start=stop)
    assert time.time() - began < 60
    assert [(x[0], x[3]) for x in rows(spark, path)] == [(R.CANCELLED, '{"considered_count": 1}')]
    assert spark.range(5).count() == 5  # others go on

    def notices(run):
        run.cancel()
        return {"considered_count": 2, "error_count": 0} if run.cancelled else {}

    assert R.execute(spark, path, notices, "test")["status"] == R.CANCELLED
