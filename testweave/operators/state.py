"""What the next run needs to know of each test, as a state that neighbouring stretches of history merge.

A state holds counts, the first and last settled outcome, the last entries and the stretch it covers. Merging is
associative: states of stretches that follow each other give the state of both, however the history is cut. So a store
keeps one small row per test and batch, and a question about a run reads states instead of all results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import rollup, settled, strict
from .classify import test_file_candidates, test_file_touched

#: Entries that a state keeps: one less than the longest window that can be asked for.
KEEP = 199
_TIME = "struct<started_at:long,run_id:long>"
STATE = f"""test_key string, suite string, test_name string, `from` {_TIME}, upto {_TIME}, entries long, passed boolean, runs long, passes long, failures long, flips long,
 first string, latest string, last_status string, last array<struct<started_at:long,run_id:long,outcome:string,touched:boolean>>"""


def states_of(runs: DataFrame, results: DataFrame) -> DataFrame:
    """The state of each test over one stretch of history (the runs given): bounded by the stretch, as a batch is."""
    touched = test_file_touched(F.col("changed_files"), test_file_candidates(F.lit(None).cast("string"), F.col("suite")))
    per = results.groupBy("test_key", "run_id").agg(F.max("suite").alias("suite"), F.max("test_name").alias("test_name"), rollup(F.col("status")).alias("status"))
    per = per.join(runs.select(F.col("id").alias("run_id"), "started_at", "changed_files"), "run_id")
    entry = F.struct("started_at", "run_id", strict(F.col("status")).alias("outcome"), touched.alias("touched"), settled(F.col("status")).alias("settled"), "status")
    all_ = per.groupBy("test_key").agg(F.max("suite").alias("suite"), F.max("test_name").alias("test_name"), F.array_sort(F.collect_list(entry)).alias("e"))
    e = F.col("e")
    o = F.filter(F.transform(e, lambda x: x["settled"]), lambda x: x.isNotNull())
    rows = all_.withColumn("o", o)
    o = F.col("o")
    neighbours = F.arrays_zip(F.slice(o, F.lit(1), F.greatest(F.size(o) - 1, F.lit(0))).alias("a"), F.slice(o, F.lit(2), F.greatest(F.size(o) - 1, F.lit(0))).alias("b"))
    time = lambda x: F.struct(x["started_at"].alias("started_at"), x["run_id"].alias("run_id"))
    count = lambda a, f: F.size(F.filter(a, f)).cast("long")
    return rows.select(
        "test_key",
        "suite",
        "test_name",
        time(F.get(e, F.lit(0))).alias("from"),
        time(F.element_at(e, -1)).alias("upto"),
        F.size(e).cast("long").alias("entries"),
        F.exists(e, lambda x: x["status"] == "passed").alias("passed"),
        F.size(o).cast("long").alias("runs"),
        count(o, lambda x: x == "pass").alias("passes"),
        count(o, lambda x: x == "fail").alias("failures"),
        count(neighbours, lambda x: x["a"] != x["b"]).alias("flips"),
        F.get(o, F.lit(0)).alias("first"),
        F.try_element_at(o, F.lit(-1)).alias("latest"),
        F.element_at(e, -1)["status"].alias("last_status"),
        F.transform(F.slice(e, F.greatest(F.size(e) - KEEP + 1, F.lit(1)), F.lit(KEEP)), lambda x: F.struct(x["started_at"].alias("started_at"), x["run_id"].alias("run_id"), x["outcome"].alias("outcome"), x["touched"].alias("touched"))).alias("last"),
    )


def _joined(a: Column, b: Column) -> Column:
    """The state of two stretches, ``a`` before ``b``."""
    turn = F.when(a["latest"].isNotNull() & b["first"].isNotNull() & (a["latest"] != b["first"]), 1).otherwise(0)
    last = F.concat(a["last"], b["last"])
    return F.struct(
        F.greatest(a["suite"], b["suite"]).alias("suite"),
        F.greatest(a["test_name"], b["test_name"]).alias("test_name"),
        a["from"].alias("from"),
        b["upto"].alias("upto"),
        (a["entries"] + b["entries"]).alias("entries"),
        (a["passed"] | b["passed"]).alias("passed"),
        (a["runs"] + b["runs"]).alias("runs"),
        (a["passes"] + b["passes"]).alias("passes"),
        (a["failures"] + b["failures"]).alias("failures"),
        (a["flips"] + b["flips"] + turn).cast("long").alias("flips"),
        F.coalesce(a["first"], b["first"]).alias("first"),
        F.coalesce(b["latest"], a["latest"]).alias("latest"),
        b["last_status"].alias("last_status"),
        F.slice(last, F.greatest(F.size(last) - KEEP + 1, F.lit(1)), F.lit(KEEP)).alias("last"),
    )


def merged(states: DataFrame) -> DataFrame:
    """One state per test from those of its stretches, in their order; ``overlap`` marks tests whose stretches run into each other.

    A test has as many rows as there are batches that are not compacted, so a group is small.
    """
    names = [c for c in states.columns if c != "test_key"]
    per = states.groupBy("test_key").agg(F.array_sort(F.collect_list(F.struct("from", "upto", *(c for c in names if c not in ("from", "upto"))))).alias("s"))
    s = F.transform(F.col("s"), lambda x: F.struct(*(x[c].alias(c) for c in names)))
    per = per.withColumn("s", s)
    s = F.col("s")
    follow = F.arrays_zip(F.slice(s, F.lit(1), F.size(s) - 1).alias("a"), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))).alias("b"))
    whole = F.aggregate(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.get(s, F.lit(0)), _joined)
    out = per.select("test_key", whole.alias("w"), F.exists(follow, lambda x: x["a"]["upto"] >= x["b"]["from"]).alias("overlap"))
    return out.select("test_key", "w.*", "overlap")


def stats(states: DataFrame, min_runs: int = 3) -> DataFrame:
    """Flips and their rate per test, as the windows over all results give them."""
    rate = F.when(F.col("runs") > 1, F.col("flips") / (F.col("runs") - 1)).otherwise(0.0)
    return states.where(F.col("runs") >= min_runs).select("test_key", "suite", "test_name", F.col("runs").alias("n_runs"), "flips", "passes", "failures", "last_status", rate.alias("flip_rate"))


def next_run_facts(states: DataFrame, entries: DataFrame, window: int = 30) -> DataFrame:
    """prior_runs, ever_passed, considered, flips, unexplained of (test_key, run_id, outcome, touched), the entries that follow the states."""
    if not 1 <= window <= KEEP + 1:
        raise ValueError(f"a state keeps {KEEP} entries: the window is 1 to {KEEP + 1}")
    met = entries.join(states.select("test_key", F.col("entries").alias("n"), "passed", "last"), "test_key", "left")
    own = F.array(F.struct("outcome", "touched"))
    before = F.transform(F.coalesce("last", F.array().cast("array<struct<started_at:long,run_id:long,outcome:string,touched:boolean>>")), lambda x: F.struct(x["outcome"].alias("outcome"), x["touched"].alias("touched")))
    room = window - 1
    line = F.concat(F.slice(before, F.greatest(F.size(before) - room + 1, F.lit(1)), F.lit(room)), own) if room else own
    met = met.withColumn("line", line)
    line = F.col("line")
    pairs = F.arrays_zip(F.slice(line, F.lit(1), F.size(line) - 1).alias("a"), F.slice(line, F.lit(2), F.size(line) - 1).alias("b"))
    flip = lambda x: x["a"]["outcome"] != x["b"]["outcome"]
    count = lambda f: F.size(F.filter(pairs, f)).cast("long")
    return met.select("test_key", "run_id", F.coalesce("n", F.lit(0)).cast("long").alias("prior_runs"), F.coalesce("passed", F.lit(False)).alias("ever_passed"), F.size(line).cast("long").alias("considered"), count(flip).alias("flips"), count(lambda x: flip(x) & ~x["b"]["touched"]).alias("unexplained"))
