"""Facts against their definition, row by row, on random histories."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from testweave.operators import classify as C
from testweave.operators.explain import verdicts
from testweave.operators.facts import facts
from testweave.plans import adapters
from testweave.plans import catalog
from testweave.schema import RESULTS, RUNS

DAY = 86_400_000


def history(seed, n=60):
    rng = random.Random(seed)
    runs, results = [], []
    for i in range(1, n + 1):
        # starts tie, fall on borders of days, and don't follow the ids
        runs.append((i, "r", f"c{rng.randrange(8)}", rng.choice([None, *(f"c{k}" for k in range(8))]), rng.choice([None, "main", "b1", "b2", "b3", "b4"]), None, rng.randint(1, 3), rng.choice([0, 5, DAY - 1, DAY, DAY + 3, 2 * DAY, 3 * DAY + rng.randrange(4)]), [rng.choice(["a/s.py", "b.py"])]))
        for t in range(rng.randint(0, 4)):
            key = f"t{rng.randrange(4)}"
            status = rng.choice(["passed", "passed", "failed", "error", "skipped"])
            bad = status in ("failed", "error")
            results.append((len(results), i, "x.s", key, key, status, 5, "m" if bad else None, None, rng.choice([None, "f1", "f1", "f2"]) if bad else None))
    return runs, results


def brute(runs, results, as_of, window=30):
    run = {r[0]: r for r in runs}
    at = lambda i: (run[i][7], i)
    out = {}
    for r in results:
        if r[5] not in ("failed", "error"):
            continue
        me, own = at(r[1]), run[r[1]]
        counts = lambda o: as_of == "now" or at(o[1]) < me
        entries = {}
        for o in results:
            if o[4] == r[4] and at(o[1]) <= me:
                entries.setdefault(at(o[1]), []).append(o[5])
        line = [("fail" if {"failed", "error"} & set(s) or "passed" not in s else "pass", "a/s.py" in run[k[1]][8]) for k, s in sorted(entries.items())]
        last = line[-window:]
        flips = [b for a, b in zip(last, last[1:]) if a[0] != b[0]]
        parent = [o[5] for o in results if o[4] == r[4] and run[o[1]][2] == own[3] and counts(o)]
        outcome = "fail" if {"failed", "error"} & set(parent) else "pass" if "passed" in parent else None
        elsewhere = any(o[4] == r[4] and o[5] == "passed" and run[o[1]][2] == own[2] and run[o[1]][6] != own[6] and counts(o) for o in results)
        branches = {run[o[1]][4] for o in results if r[9] and o[9] == r[9] and counts(o)} - {None}
        out[r[0]] = (len(line) - 1, any(o == "pass" for o, _ in line[:-1]), len(last), len(flips), sum(not t for _, t in flips), elsewhere, outcome, max(1, len(branches)))
    return out


def told(frame):
    return {r.id: (r.prior_runs, r.ever_passed, r.considered, r.flips or 0, r.unexplained or 0, r.passed_elsewhere, r.parent_outcome, r.branches) for r in frame.collect()}


@pytest.mark.parametrize("as_of", ["run", "now"])
@pytest.mark.parametrize("window", [30, 3])
def test_equal_the_definition(spark, as_of, window):
    for seed in range(3):
        runs, results = history(seed)
        u, r = spark.createDataFrame(runs, RUNS), spark.createDataFrame(results, RESULTS).repartition(3)
        want = brute(runs, results, as_of, window)
        assert told(facts(u, r, window, as_of=as_of)) == want
        some = spark.createDataFrame([(i,) for i in range(7, 60, 9)], "run_id long")
        assert told(facts(u, r, window, some, as_of)) == {x[0]: want[x[0]] for x in results if x[0] in want and x[1] in range(7, 60, 9)}


def test_a_later_run_is_not_seen(spark):
    """One fingerprint on four branches, one after the other, and a pass of the first commit at last."""
    runs = [(i, "r", f"c{i}" if i < 5 else "c1", "p", f"b{i}", None, i, i * 10, []) for i in range(1, 6)]
    results = [(i, i, "s", f"t{i}" if i < 5 else "t1", f"t{i}" if i < 5 else "t1", "failed" if i < 5 else "passed", 1, "m", None, "fp" if i < 5 else None) for i in range(1, 6)]
    u, r = spark.createDataFrame(runs, RUNS), spark.createDataFrame(results, RESULTS)
    before, now = facts(u, r), facts(u, r, as_of="now")
    assert {x.id: (x.branches, x.passed_elsewhere) for x in before.collect()} == {1: (1, False), 2: (1, False), 3: (2, False), 4: (3, False)}
    assert {x.id: (x.branches, x.passed_elsewhere) for x in now.collect()} == {1: (4, True), 2: (4, False), 3: (4, False), 4: (4, False)}
    assert {x.id: x.kind for x in verdicts(u, r).collect()} == {1: "ambiguous", 2: "ambiguous", 3: "ambiguous", 4: "flake_likely"}
    with pytest.raises(ValueError):
        facts(u, r, as_of="then")


@pytest.mark.parametrize("as_of", ["run", "now"])
def test_results_meet_their_runs_before_they_are_dealt_out_by_test(spark, as_of):
    """All results are shuffled twice (by run and by test), with keys as bytes and without the runs' changed files."""
    d = "/root/testdata/sf0.001"
    rows = facts(adapters.runs(spark, d), adapters.results(spark, d), as_of=as_of).drop("changed_files")
    plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    by_test = [x for x in plan if "RepartitionByExpression [test_key" in x]
    assert len(by_test) == 1
    at, depth = plan.index(by_test[0]) + 1, by_test[0].index("RepartitionBy")
    below = "\n".join(itertools.takewhile(lambda x: len(x) - len(x.lstrip(" :+-")) > depth, plan[at:]))
    assert "unhex" in below and "arrays_overlap" in below
    assert "Window" not in below and "Join" in below and "Aggregate" not in below


def test_empty(spark):
    u, r = spark.createDataFrame([], RUNS), spark.createDataFrame([], RESULTS)
    assert facts(u, r).count() == 0 and verdicts(u, r).count() == 0


def test_the_adapter_has_all_kinds_and_states(spark):
    d = "/root/testdata/sf0.01"
    u, r = adapters.runs(spark, d), adapters.results(spark, d)
    v = catalog.verdict_rows(u, r).select("id", "test_key", "kind", "confidence", "evidence").cache()
    n = {(x.kind, x.confidence): x["count"] for x in v.groupBy("kind", "confidence").count().collect()}
    assert {k for k, _ in n} == set(C.KINDS) and {c for k, c in n if k == "real_regression"} == {"high", "medium"}, n
    items = r.select("id", "test_key", F.col("duration_ms").alias("tokens"))
    states = {x.state for g in (100_000, 10_000) for x in C.escalation_plan(v, items, guardrail=g).select("state").distinct().collect()}
    assert states == {"sent", "deferred", "too_large"}
    assert C.exit_code(v).first()["exit_code"] == 1 and C.headline(v).first()["light"] == "red"
    v.unpersist()
