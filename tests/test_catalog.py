"""Every query with SQL against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from testweave.operators import classify as C
from testweave.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, DATA)
    cols = sorted(frame.columns)
    got = sorted((tuple(r) for r in frame.select(*cols).collect()), key=str)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    rows = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
    assert len(got) == len(rows)
    assert all(same(x, y) for g, w in zip(got, rows) for x, y in zip(g, w)), [(g, w) for g, w in zip(got, rows) if g != w][:3]


@pytest.mark.parametrize("name", "classify classify_now group_top8 action_bucket bucket_summary headline exit_code json_report accounting apply_escalation escalation_batch escalation_plan escalation_too_large group_by_action run_report blame_proximity blame_correlate top_blame".split())
def test_no_join_sends_the_history_to_the_driver(spark, name):
    """At Spark's own limit for broadcasts, whatever tables are estimated at: only what a fixed number of rows bounds may be sent."""
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    sent = [x for x in plan.split("\n") if "BroadcastHashJoin" in x]
    # the counts of kinds, confidences and slots; answers have one row a test
    assert len(sent) <= (name in ("group_by_action", "apply_escalation", "accounting")), sent


def test_the_top_of_each_bucket_takes_one_pass(spark):
    """The verdicts are judged once: no table is read more often than for the verdicts alone."""
    reads = lambda name: catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString().count("FileScan")
    assert reads("group_top8") <= reads("classify")
    rows = [(i % 900, k, c) for i, (k, c) in enumerate([("ambiguous", "low"), ("flake_likely", "medium"), ("infra_failure", "high")] * 400)] + [(5, "real_regression", "high")]
    got = C.top_of_groups(spark.createDataFrame(rows, "id long, kind string, confidence string").repartition(3)).collect()
    want = []
    for b in C.BUCKETS:
        mine = sorted((C.KINDS.index(k), -{"high": 2, "medium": 1, "low": 0}[c], i, k) for i, k, c in rows if C.BUCKET[k] == b)
        want += [(i, k, b, max(len(mine) - 8, 0)) for _, _, i, k in mine[:8]]
    assert sorted((r.id, r.kind, r.bucket, r.more) for r in got) == sorted(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.ORACLES) <= set(entry.oracle_sql()) and set(catalog.QUERIES) <= set(entry.queries())
