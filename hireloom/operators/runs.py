"""Runs as a table of what happened to them: created, then completed, failed or cancelled.

A run is two rows that are appended, never changed: one that opens it and one that closes
it; a run without the second is still going, or died with its driver. The work runs under
the run's own job tag, so another thread cancels exactly its jobs. Whatever the work
raises is raised again after the run is closed, also if closing it fails.
"""

from __future__ import annotations

import datetime
import json
import logging
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "run_id string, event int, status string, at string, initiated_by string, counts string, versions string"
STARTED, COMPLETED, PARTIALLY_FAILED, FAILED, CANCELLED = "STARTED", "COMPLETED", "PARTIALLY_FAILED", "FAILED", "CANCELLED"
log = logging.getLogger(__name__)


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


@dataclass
class Run:
    """What the work is given: its id, counts to keep, and whether it has been cancelled."""

    spark: SparkSession
    run_id: str
    counts: dict[str, int] = field(default_factory=dict)
    _stop: threading.Event = field(default_factory=threading.Event)

    @property
    def tag(self) -> str:
        return f"hireloom-run-{self.run_id}"

    @property
    def cancelled(self) -> bool:
        return self._stop.is_set()

    def cancel(self) -> None:
        """Stops the run's jobs; from any thread."""
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


class Cancelled(RuntimeError):
    """Raised by work that stops because its run was cancelled."""


def _append(spark: SparkSession, path: str, run_id: str, event: int, status: str, at: str, initiated_by: str, counts: dict[str, int], versions: dict[str, str]) -> None:
    row = (run_id, event, status, at, initiated_by, json.dumps(counts, sort_keys=True), json.dumps(versions, sort_keys=True))
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def execute(spark: SparkSession, path: str, work: Callable[[Run], dict[str, int]], initiated_by: str, versions: dict[str, str] | None = None, clock: Callable[[], str] = now, on_start: Callable[[Run], None] | None = None) -> dict[str, object]:
    """Runs work(run), which returns counts with error_count and considered_count among them,
    between the run's two rows at path; the summary that is returned has its status too."""
    run, versions = Run(spark, uuid.uuid4().hex), versions or {}
    started = clock()
    _append(spark, path, run.run_id, 0, STARTED, started, initiated_by, {}, versions)
    if on_start:
        on_start(run)
    context = spark.sparkContext
    context.addJobTag(run.tag)
    try:
        run.counts.update(work(run))
        errors, considered = run.counts.get("error_count", 0), run.counts.get("considered_count", 0)
        status = CANCELLED if run.cancelled else COMPLETED if errors == 0 else PARTIALLY_FAILED if errors < considered else FAILED
    except BaseException as error:
        context.removeJobTag(run.tag)  # the closing row is not the run's own job
        status = CANCELLED if run.cancelled else FAILED
        try:
            _append(spark, path, run.run_id, 1, status, clock(), initiated_by, run.counts, versions)
        except Exception:
            log.exception("run %s could not be closed", run.run_id)
        if run.cancelled:
            raise Cancelled(f"Run {run.run_id} was cancelled.") from error
        raise
    context.removeJobTag(run.tag)
    completed = clock()
    _append(spark, path, run.run_id, 1, status, completed, initiated_by, run.counts, versions)
    return {"run_id": run.run_id, "started_at": started, "completed_at": completed, "status": status, **run.counts}


def runs(spark: SparkSession, path: str) -> DataFrame:
    """A row a run: its times, its status (STARTED while it is open), counts and versions as JSON."""
    return states(spark.read.schema(SCHEMA).parquet(path))


def states(events: DataFrame) -> DataFrame:
    """Runs of their events; the first that closes a run counts."""
    first = events.withColumn("n", F.row_number().over(Window.partitionBy("run_id", "event").orderBy("at"))).where("n = 1")
    opened = first.where("event = 0").select("run_id", F.col("at").alias("started_at"), "initiated_by", "versions")
    closed = first.where("event = 1").select("run_id", F.col("at").alias("completed_at"), "status", "counts")
    return opened.join(closed, "run_id", "left").withColumns({"status": F.coalesce("status", F.lit(STARTED)), "counts": F.coalesce("counts", F.lit("{}"))})
