"""Commands: validate-config, process, collect. Exit codes 0; 1 or 2 for configuration; 4 for a run that failed or was cancelled; 3 others."""

from __future__ import annotations

import argparse
import datetime
import json
import sys

from pyspark.sql import SparkSession

from .operators.process import check_limit, config_fingerprint, summary
from .sources.configuration import ConfigurationError, load_configuration, summarize


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="hireloom")
    verbs = top.add_subparsers(dest="verb", required=True)
    check = verbs.add_parser("validate-config")
    run = verbs.add_parser("process")
    for verb in (check, run):
        verb.add_argument("--config-dir", default="config")
        verb.add_argument("--json", action="store_true")
    check.add_argument("--examples", action="store_true")
    run.add_argument("--limit", type=int, default=1000)
    run.add_argument("--jobs", required=True, help="Parquet of postings, first references and revisions joined")
    run.add_argument("--decisions", required=True, help="Parquet that decisions are appended to")
    run.add_argument("--runs", help="Folder of the runs' rows; none are kept without it")
    get = verbs.add_parser("collect")
    get.add_argument("--json", action="store_true")
    get.add_argument("--store", required=True, help="Folder of the store's versions and runs")
    for name, said in (("sources", "source_id, type, company, url and settings"), ("bodies", "source_id and a board's body"), ("pages", "url, html and rendered html")):
        get.add_argument(f"--{name}", required=True, help=f"Parquet of {said}")
    a = top.parse_args(argv)
    say = lambda x: print(json.dumps(x) if a.json else "\n".join(f"{k}: {v}" for k, v in x.items()))
    if a.verb == "collect":
        from .operators.collection import collect

        spark = SparkSession.builder.getOrCreate()
        done = collect(spark, a.store, *(spark.read.parquet(x) for x in (a.sources, a.bodies, a.pages)))
        say(done)
        return 4 if done["status"] in ("FAILED", "CANCELLED") else 0
    try:
        who, filters, raw = load_configuration(a.config_dir, getattr(a, "examples", False))
    except ConfigurationError as e:
        for i in e.issues:
            print(f"{i.code} {i.section} {i.path}: {i.message}", file=sys.stderr)
        return 1 if a.verb == "validate-config" else 2
    if a.verb == "validate-config":
        say(summarize(raw))
        return 0
    try:
        check_limit(a.limit)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    now = datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    from .streaming.incremental import append_decisions

    from .operators import runs

    def work(run: runs.Run | None) -> dict[str, object]:
        batch = spark.read.parquet(a.jobs).orderBy("last_collected_at", "id").limit(a.limit)
        append_decisions(batch, a.decisions, who, filters, now)
        made = spark.read.parquet(a.decisions)
        made = made.where((made["processed_at"] == now) & (made["config_fingerprint"] == config_fingerprint(who, filters)))
        return summary(batch, made).first().asDict()

    row = runs.execute(spark, a.runs, work, "cli") if a.runs else work(None)
    say(row)
    return 4 if row["status"] in ("FAILED", "CANCELLED") else 0


if __name__ == "__main__":
    sys.exit(main())
