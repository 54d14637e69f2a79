"""Questions about the history on random histories, against their definition."""

from pyspark.sql import functions as F

from testweave.functions import keys as K
from testweave.operators import history as H
from testweave.schema import RESULTS, RUNS

from .test_facts import history


def test_packed_keys_come_back(spark):
    keys = ["ab" * 32, "AB" * 32, "abc", "ab", "", "part1", "é::ö", "ab\n", "\u0001ab", None]
    c = F.col("k")
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", K.packed_key(c).alias("p"), K.unpacked_key(K.packed_key(c)).alias("u")).collect()
    assert [r.u for r in got] == keys and len({r.p and bytes(r.p) for r in got}) == len(keys)
    assert len(got[0].p) == 33


def test_parent_outcome(spark):
    for seed in range(3):
        runs, results = history(seed)
        runs = [(*r[:2], None if r[0] % 9 == 0 else r[2], *r[3:]) for r in runs]
        run = {r[0]: r for r in runs}
        want = set()
        for r in results:
            there = {o[5] for o in results if o[4] == r[4] and run[o[1]][2] is not None and run[o[1]][2] == run[r[1]][3]}
            want.add((r[1], r[4], "fail" if there & {"failed", "error"} else "pass" if "passed" in there else None))
        schema = RUNS if RUNS["commit_sha"].nullable else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RUNS)
        got = H.parent_outcome(spark.createDataFrame(runs, schema), spark.createDataFrame(results, RESULTS).repartition(3)).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_parent_outcome_takes_two_shuffles_of_the_results(spark):
    d = "/root/testdata/sf0.001"
    from testweave.plans import catalog

    plan = catalog.QUERIES["parent_outcome"](spark, d)._jdf.queryExecution().executedPlan().toString()
    # the deal-out of the adapter's single row group aside: results and runs by run, results by test
    assert sum("Exchange hashpartitioning" in x for x in plan.split("\n")) == 3, plan
