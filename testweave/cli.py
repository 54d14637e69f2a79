"""Command line: record reports and judge them, rank flaky tests, explain one test, list its history, take in past runs, compact the store."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import HistoryError, NoReportsError
from .operators import classify as C
from .operators import history as H
from .operators import report as P
from .operators.explain import explain, explain_text, verdicts
from .operators.state import KEEP
from .schema import RUNS
from .sources.reports import PATTERNS, analyzed, read_reports
from .sources.store import HistoryStore, backfill_archives


def record_and_judge(spark, store: HistoryStore, root: str, run: dict, patterns=PATTERNS, window: int = 30):
    """Read the reports below ``root``, append them as one run, and return the verdicts of its failures."""
    rows = analyzed(read_reports(spark, root, patterns))
    if rows.isEmpty():
        raise NoReportsError(root)
    ordered = rows.withColumn("id", F.xxhash64("path", "ordinal")).select("id", F.lit(0).cast("long").alias("run_id"), "suite", F.col("name").alias("test_name"), "test_key", "status", "duration_ms", F.col("failure.message").alias("message"), F.col("failure.stack").alias("stack"), "fingerprint")
    one = spark.createDataFrame([{"id": 0, "parent_sha": None, "branch": None, "ci_run_id": None, "attempt": 1, "changed_files": [], "repo": "", **run}], RUNS)
    given = store.record(one, ordered)
    ids = given.select(F.col("id").alias("run_id"))
    if window > KEEP + 1:
        return verdicts(store.runs(), store.results(), window, ids)
    # states of tests stand for the history: only this batch's results are read
    mine = [store.last]
    return verdicts(store.runs(mine), store.results(mine), window, ids, rows=store.run_facts(ids, store.last, window))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="testweave")
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run")
    r.add_argument("root")
    r.add_argument("--commit", required=True)
    r.add_argument("--parent")
    r.add_argument("--branch")
    r.add_argument("--repo", default="")
    r.add_argument("--ci-run")
    r.add_argument("--attempt", type=int, default=1)
    r.add_argument("--changed", nargs="*", default=[])
    r.add_argument("--window", type=int, default=30)
    r.add_argument("--format", choices=("text", "markdown", "json"), default="text")
    r.add_argument("--fail-on", choices=("never", "any", "regression"), default="never")
    s = sub.add_parser("stats")
    s.add_argument("--window", type=int, default=200)
    s.add_argument("--min-runs", type=int, default=3)
    b = sub.add_parser("backfill")
    b.add_argument("runs", help="table of past runs")
    b.add_argument("artifacts", help="table of their archives: run_id, name, expired, content")
    b.add_argument("--artifact-name", default="*")
    b.add_argument("--days", type=float)
    b.add_argument("--since", type=int)
    c = sub.add_parser("compact")
    c.add_argument("--vacuum", action="store_true")
    for name in ("explain", "history"):
        e = sub.add_parser(name)
        e.add_argument("query")
        e.add_argument("--limit", type=int, default=20)
        e.add_argument("--format", choices=("text", "json"), default="json")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("testweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = HistoryStore(spark, a.store)
    try:
        if a.command == "run":
            run = {"commit_sha": a.commit, "parent_sha": a.parent, "branch": a.branch, "repo": a.repo, "ci_run_id": a.ci_run, "attempt": a.attempt, "started_at": int(time.time() * 1000), "changed_files": a.changed}
            v = record_and_judge(spark, store, a.root, run, window=a.window)
            print("\n".join(x["json"] for x in P.json_lines(v).toLocalIterator()) if a.format == "json" else P.render(v, a.format))
            return C.exit_code(v, a.fail_on).first()["exit_code"]
        if a.command == "backfill":
            cutoff = None if a.days is None else int((time.time() - a.days * 86_400) * 1000)
            print(json.dumps(backfill_archives(store, spark.read.parquet(a.runs), spark.read.parquet(a.artifacts), a.artifact_name, cutoff, a.since)))
            return 0
        if a.command == "compact":
            print(json.dumps({"batch": store.compact(), "deleted": store.vacuum() if a.vacuum else 0}))
            return 0
        if a.command == "stats":
            top = H.top_flaky(H.flaky_stats(H.rows_for_flakiness(store.runs(), store.results(), a.window), a.min_runs)).collect()
            print(json.dumps([t.asDict() for t in top], indent=1))
        else:
            found = explain(store.runs(), store.results(), a.query, a.limit)
            if a.command == "explain" and a.format == "text":
                print(explain_text(found))
                return 0
            print(json.dumps(found if a.command == "explain" else {k: found[k] for k in ("test", "timeline", "flips")}, indent=1, default=str))
        return 0
    except HistoryError as e:
        print(f"{e.code}: {e}")
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
