"""The test history's questions, over all tests and runs at once.

``runs`` and ``results`` have the columns of :mod:`testweave.schema`. Every point look-up of a single test is here one
grouping or join on its key, so a table of verdicts for all failures needs one shuffle per key family. Aggregates
combine before the shuffle; joins are left to the optimizer (adaptive joins broadcast a side once its size is known).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import failing, packed_key, rollup, settled, unpacked_key

ORDER = ("started_at", "run_id")


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the history: sorted and shuffled, never a broadcast.

    Spark's estimate counts an array, and what is unfolded from it or collected into it, as one entry, so a table many
    times too large for the driver could pass for a small one.
    """
    return left.join(right.hint("merge"), on, how)


def joined(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Results with their run's columns."""
    return results.join(runs.withColumnRenamed("id", "run_id"), "run_id")


def status_rollup(results: DataFrame) -> DataFrame:
    return results.groupBy("test_key", "run_id").agg(rollup(F.col("status")).alias("status"))


def outcome_on_commit(runs: DataFrame, results: DataFrame) -> DataFrame:
    """pass, fail or null (only skipped) for each test on each commit, over all runs of the commit."""
    rolled = joined(runs, results).groupBy("commit_sha", "test_key").agg(rollup(F.col("status")).alias("status"))
    return rolled.select("commit_sha", "test_key", settled(F.col("status")).alias("outcome"))


def timeline(runs: DataFrame, results: DataFrame) -> DataFrame:
    """One row per test and run: status, total duration, largest message and fingerprint among failing rows, and the run's columns."""
    bad = failing(F.col("status"))
    per = results.groupBy("test_key", "run_id").agg(F.max("suite").alias("suite"), rollup(F.col("status")).alias("status"), F.sum("duration_ms").alias("duration_ms"), F.max(F.when(bad, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(bad, F.col("message"))).alias("message"))
    about = runs.select(F.col("id").alias("run_id"), "commit_sha", "branch", "attempt", "started_at", "changed_files")
    return per.join(about, "run_id")


def rows_for_flakiness(runs: DataFrame, results: DataFrame, window: int = 200) -> DataFrame:
    """Rolled-up rows of the last ``window`` run ids, skipped ones included."""
    last = runs.agg((F.max("id") - F.lit(window)).alias("after"))
    recent = runs.join(F.broadcast(last), F.col("id") > F.col("after")).select(F.col("id").alias("run_id"), "started_at")  # one row
    per = results.groupBy("test_key", "run_id").agg(rollup(F.col("status")).alias("status"), F.max("suite").alias("suite"), F.max("test_name").alias("test_name"), F.max("fingerprint").alias("fingerprint"))
    return per.join(recent, "run_id")


def flaky_stats(rows: DataFrame, min_runs: int = 3) -> DataFrame:
    """Flips between neighbouring settled outcomes and their rate, per test with ``min_runs`` settled runs."""
    of = W.partitionBy("test_key").orderBy(*ORDER)
    o = rows.withColumn("outcome", settled(F.col("status")))
    seen = o.withColumn("before", F.last("outcome", ignorenulls=True).over(of.rowsBetween(W.unboundedPreceding, -1)))
    flip = (F.col("outcome").isNotNull() & F.col("before").isNotNull() & (F.col("outcome") != F.col("before"))).cast("long")
    per = seen.groupBy("test_key").agg(
        F.max("suite").alias("suite"),
        F.max("test_name").alias("test_name"),
        F.count("outcome").alias("n_runs"),
        F.sum(flip).alias("flips"),
        F.count_if(F.col("outcome") == "pass").alias("passes"),
        F.count_if(F.col("outcome") == "fail").alias("failures"),
        F.max_by("status", F.struct(*ORDER)).alias("last_status"),
        F.count_distinct("fingerprint").alias("fingerprints"),
    )
    rate = F.when(F.col("n_runs") > 1, F.col("flips") / (F.col("n_runs") - 1)).otherwise(0.0)
    return per.where(F.col("n_runs") >= min_runs).withColumn("flip_rate", rate)


def top_flaky(stats: DataFrame, k: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("flip_rate"), F.desc("flips"), F.desc("n_runs"), "test_key").limit(k)


def fingerprint_spread(runs: DataFrame, results: DataFrame) -> DataFrame:
    """How far each failure fingerprint has spread; the sample message is the smallest."""
    rows = joined(runs, results.where(F.col("fingerprint").isNotNull()))
    return rows.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("branch").alias("branches"),
        F.count_distinct("commit_sha").alias("commits"),
        F.count_distinct("test_key").alias("tests"),
        F.min("started_at").alias("first_seen"),
        F.max("started_at").alias("last_seen"),
        F.min("message").alias("sample_message"),
    )


def history_summary(runs: DataFrame, results: DataFrame) -> DataFrame:
    r = runs.agg(F.count(F.lit(1)).alias("runs"), F.min("started_at").alias("first_run"), F.max("started_at").alias("last_run"))
    t = results.agg(F.count(F.lit(1)).alias("results"), F.count_distinct("test_key").alias("tests"), F.count_distinct("fingerprint").alias("fingerprints"))
    return r.join(F.broadcast(t))  # one row each


def run_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("test_key").agg(F.count_distinct("run_id").alias("n_runs"))


def ever_passed(results: DataFrame) -> DataFrame:
    return results.groupBy("test_key").agg(F.bool_or(F.col("status") == "passed").alias("ever_passed"))


def same_run(a: DataFrame, b: DataFrame) -> Column:
    """The tuple that identifies a run; runs without a CI id are never the same."""
    return (a["repo"] == b["repo"]) & (a["commit_sha"] == b["commit_sha"]) & (a["ci_run_id"] == b["ci_run_id"]) & (a["attempt"] == b["attempt"])


def run_exists(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Candidates whose tuple is recorded; a missing CI id equals a missing one here (a look-up, not the uniqueness rule)."""
    on = (candidates["repo"] == runs["repo"]) & (candidates["commit_sha"] == runs["commit_sha"]) & candidates["ci_run_id"].eqNullSafe(runs["ci_run_id"]) & (candidates["attempt"] == runs["attempt"])
    return candidates.join(runs, on, "left_semi")


def new_runs(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Candidates to record: not there yet, one per tuple (the smallest id); those without a CI id all count as new."""
    of = W.partitionBy("repo", "commit_sha", "ci_run_id", "attempt").orderBy("id")
    first = candidates.withColumn("_k", F.row_number().over(of)).where(F.col("ci_run_id").isNull() | (F.col("_k") == 1)).drop("_k")
    return first.join(runs, same_run(first, runs), "left_anti")


def find_tests(results: DataFrame, query: str) -> DataFrame:
    """Tests by exact name, by part of suite::name or by start of the key (the last two in either case; % and _ are wildcards)."""
    q = query.replace("\\", "\\\\")
    hit = (F.col("test_name") == query) | F.concat("suite", F.lit("::"), "test_name").ilike(f"%{q}%") | F.col("test_key").ilike(f"{q}%")
    found = results.where(hit).groupBy("test_key").agg(F.max("suite").alias("suite"), F.max("test_name").alias("test_name"), F.count_distinct("run_id").alias("n_runs"))
    return found.orderBy(F.desc("n_runs"), "suite", "test_name", "test_key")


def of_test(results: DataFrame, key: str) -> DataFrame:
    """One test's results; where the table lies in parts by the key's first digit, only its part is read."""
    mine = results.where(F.col("test_key") == key)
    return mine.where(F.col("part") == key[:1]) if "part" in results.columns else mine


def passed_in_another_attempt(runs: DataFrame, results: DataFrame) -> DataFrame:
    """(commit_sha, test_key, attempt) that have a pass in a different attempt of the commit."""
    rows = joined(runs, results).select("commit_sha", "test_key", "attempt", "status")
    passes = rows.where("status = 'passed'").groupBy("commit_sha", "test_key").agg(F.min("attempt").alias("lo"), F.max("attempt").alias("hi"))
    return rows.select("commit_sha", "test_key", "attempt").distinct().join(passes, ["commit_sha", "test_key"]).where("lo <> attempt or hi <> attempt").select("commit_sha", "test_key", "attempt")


def failed_attempts(runs: DataFrame, results: DataFrame) -> DataFrame:
    """All attempts of a commit in which a test failed, sorted."""
    bad = joined(runs, results.where(failing(F.col("status"))))
    return bad.groupBy("commit_sha", "test_key").agg(F.array_sort(F.collect_set("attempt")).alias("attempts"))


def parent_outcome(runs: DataFrame, results: DataFrame) -> DataFrame:
    """For each (run, test): its outcome on the run's parent commit, null where unknown.

    One layout by test: every run stands once under its own commit and once under its parent's, so that a window over
    (test, commit) looks the outcome up without a join. Keys are shuffled packed.
    """
    about = runs.select(F.col("id").alias("run_id"), "commit_sha", "parent_sha")
    rows = meet(results.select("run_id", packed_key(F.col("test_key")).alias("test_key"), failing(F.col("status")).alias("failed"), (F.col("status") == "passed").alias("passed")), about, "run_id")
    each = [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("failed", "passed")]
    per = rows.repartition("test_key").groupBy("test_key", "run_id").agg(*each, F.first("commit_sha").alias("commit_sha"), F.first("parent_sha").alias("parent_sha"))
    at = F.array(F.struct(F.col("commit_sha").alias("sha"), F.lit(True).alias("own")), F.struct(F.col("parent_sha").alias("sha"), F.lit(False).alias("own")))
    both = per.select("test_key", "run_id", "failed", "passed", F.explode(at).alias("at"))
    on = W.partitionBy("test_key", "at.sha")
    seen = both.withColumns({c: F.bool_or(F.col("at.own") & F.col(c)).over(on) for c in ("failed", "passed")}).where(~F.col("at.own"))
    outcome = F.when(F.col("at.sha").isNotNull() & F.col("test_key").isNotNull(), F.when(F.col("failed"), "fail").when(F.col("passed"), "pass"))
    return seen.select("run_id", unpacked_key(F.col("test_key")).alias("test_key"), outcome.alias("parent_outcome"))


def recent_window(rows: DataFrame, window: int = 30) -> DataFrame:
    """The last ``window`` - 1 entries of each test's timeline (a window of 1 leaves none for the past)."""
    of = W.partitionBy("test_key").orderBy(F.desc("started_at"), F.desc("run_id"))
    return rows.withColumn("back", F.row_number().over(of)).where(F.col("back") <= window - 1)


def flips(rows: DataFrame, outcome: Column, touched: Column | None = None) -> DataFrame:
    """Flips of an outcome along each test's timeline; unexplained ones have a later run that didn't touch the test file."""
    of = W.partitionBy("test_key").orderBy(*ORDER)
    before = rows.select("test_key", *ORDER, outcome.alias("o"), (touched if touched is not None else F.lit(False)).alias("touched")).withColumn("b", F.lag("o").over(of))
    flip = F.coalesce(F.col("o") != F.col("b"), F.lit(False))
    return before.groupBy("test_key").agg(F.count(F.lit(1)).alias("considered"), F.count_if(flip).alias("total"), F.count_if(flip & ~F.col("touched")).alias("unexplained"))


def history_flips(rows: DataFrame, limit: int = 20) -> DataFrame:
    """Flips over the last ``limit`` entries; skips go after the limit is taken."""
    of = W.partitionBy("test_key").orderBy(F.desc("started_at"), F.desc("run_id"))
    last = rows.withColumn("back", F.row_number().over(of)).where(F.col("back") <= limit)
    return flips(last.where(F.col("status") != "skipped"), settled(F.col("status"))).select("test_key", F.col("considered").alias("n"), F.col("total").alias("flips"))


def latest_failure(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Each test's last failing row, by start, run and result id."""
    bad = joined(runs, results.where(failing(F.col("status"))))
    cols = ["run_id", "id", "status", "message", "stack", "fingerprint", "commit_sha", "branch", "started_at"]
    return bad.groupBy("test_key").agg(F.max_by(F.struct(*cols), F.struct("started_at", "run_id", "id")).alias("r")).select("test_key", "r.*")


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n)


def flaky_passes(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Passed (run, test) pairs whose commit failed the test in other attempts."""
    passed = joined(runs, results.where("status = 'passed'")).select("run_id", "test_key", "commit_sha", "attempt").distinct()
    met = passed.join(failed_attempts(runs, results), ["commit_sha", "test_key"]).withColumn("attempts", F.array_except("attempts", F.array("attempt")))
    return met.where(F.size("attempts") > 0).select("run_id", "test_key", "attempts")


def run_totals(results: DataFrame) -> DataFrame:
    s = F.col("status")
    return results.groupBy("run_id").agg(F.count_if(s == "passed").alias("passed"), F.count_if(s == "skipped").alias("skipped"), F.count_if(failing(s)).alias("failures"))


def spread_branches(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Each failing row's number of branches that had its fingerprint, at least 1."""
    spread = fingerprint_spread(runs, results).select("fingerprint", "branches")
    bad = results.where(failing(F.col("status"))).select("id", "fingerprint")
    return bad.join(spread, "fingerprint", "left").select("id", F.greatest(F.coalesce("branches", F.lit(0)), F.lit(1)).alias("branches"))
