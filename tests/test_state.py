"""Per-test states against the windows, and the store that keeps them."""

import random

import pytest
from pyspark.sql import functions as F

from testweave.errors import StoreVersionError
from testweave.operators import history as H
from testweave.operators import state as S
from testweave.operators.explain import explain
from testweave.operators.facts import facts
from testweave.schema import RESULTS, RUNS
from testweave.sources.store import HistoryStore
from tests.test_facts import history, told


def frames(spark, runs, results):
    return spark.createDataFrame(runs, RUNS), spark.createDataFrame(results, RESULTS)


def plain(rows):
    return {r.test_key: r.asDict(recursive=True) for r in rows.collect()}


def test_states_of_any_cut_merge_to_the_whole(spark):
    runs, results = history(3, 50)
    u, r = frames(spark, runs, results)
    whole = plain(S.states_of(u, r))
    order = sorted(runs, key=lambda x: (x[7], x[0]))
    for cuts in ([10], [1, 2, 30], [5, 25, 49]):
        parts = [order[a:b] for a, b in zip([0, *cuts], [*cuts, 50])]
        states = None
        for part in parts:
            ids = {x[0] for x in part}
            s = S.states_of(*frames(spark, part, [x for x in results if x[1] in ids]))
            states = s if states is None else states.unionByName(s)
        got = plain(S.merged(states))
        assert not any(g.pop("overlap") for g in got.values()) and got == whole
        # merging some first changes nothing
        early = S.merged(states.where(F.col("upto.run_id") % 2 == 0)).where("not overlap").drop("overlap")
        assert set(plain(early)) <= set(whole)
    key = ["test_key", "n_runs", "flips", "passes", "failures", "last_status", "flip_rate"]
    want = H.flaky_stats(H.rows_for_flakiness(u, r, 1 << 60)).select(*key)
    assert sorted(map(tuple, S.stats(S.states_of(u, r)).select(*key).collect())) == sorted(map(tuple, want.collect()))


def test_a_window_longer_than_a_state_keeps(spark):
    with pytest.raises(ValueError):
        S.next_run_facts(spark.createDataFrame([], S.STATE), spark.createDataFrame([], "test_key string, run_id long, outcome string, touched boolean"), S.KEEP + 2)


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """A store of five batches, the last but one of runs that started early."""
    runs, results = history(7, 40)
    runs.sort(key=lambda x: (x[7], x[0]))
    number = {x[0]: n + 1 for n, x in enumerate(runs)}
    runs = [(number[x[0]], *x[1:5], f"ci{n}", *x[6:]) for n, x in enumerate(runs)]
    results = [(x[0], number[x[1]], *x[2:4], ("a" if x[4] < "t2" else "b") + x[4], *x[5:]) for x in results]
    store = HistoryStore(spark, str(tmp_path_factory.mktemp("store") / "h"))
    given, told_ = {}, []
    for ids in (range(1, 15), range(20, 30), [30], range(15, 20), [31]):
        mine = [x for x in runs if x[0] in ids]
        got = store.record(*frames(spark, mine, [x for x in results if x[1] in set(ids)]))
        given |= {x.given: x.id for x in got.collect()}
        told_.append((store.last, [given[i] for i in ids]))
    return store, told_


def test_facts_of_a_run_from_states(spark, filled):
    store, batches = filled
    u, r = store.runs().cache(), store.results().cache()
    for batch, ids in [batches[-1], batches[2], batches[3]]:
        asked = spark.createDataFrame([(i,) for i in ids], "run_id long")
        for window in (30, 4):
            assert told(store.run_facts(asked, batch, window)) == told(facts(u, r, window, asked))
    last = spark.createDataFrame([(batches[-1][1][0],)], "run_id long")
    plan = store.run_facts(last, batches[-1][0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") > 3
    u.unpersist()  # else later reads of the same files come from the cache
    r.unpersist()


def test_a_test_is_looked_up_in_its_part(spark, filled):
    store, _ = filled
    mine = H.of_test(store.results(), "at0")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = mine._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(test_key,at0)" in plan.split("PushedFilters")[1]
    assert mine.count() == store.results().where("test_key = 'at0'").count() > 0
    found = explain(store.runs(), store.results(), "t3")
    assert found["test"]["test_name"] == "t3" and len(found["timeline"]) > 3


def test_compaction_answers_alike_while_readers_go_on(spark, tmp_path):
    runs, results = history(9, 30)
    runs = [(*x[:5], f"ci{x[0]}", *x[6:]) for x in runs]
    store = HistoryStore(spark, str(tmp_path / "h"))
    for i in range(1, 9):
        ids = range(i, 31, 8)
        store.record(*frames(spark, [x for x in runs if x[0] in ids], [x for x in results if x[1] in set(ids)]))
    strip = lambda s: {k: {**v, "part": None} for k, v in plain(s).items()}
    before, states = sorted(map(tuple, store.results().collect()), key=str), strip(store.test_states())
    assert states == strip(S.states_of(store.runs(), store.results()))
    reader = store.results()
    files = len(reader.inputFiles())
    batch = store.compact()
    assert list(store.live()) == [batch] and store.compact() is None
    assert sorted(map(tuple, store.results().collect()), key=str) == before and strip(store.test_states()) == states
    assert sorted(map(tuple, reader.collect()), key=str) == before and len(store.results().inputFiles()) < files
    assert store.vacuum() >= 8 * 4 and sorted(map(tuple, store.results().collect()), key=str) == before and store.runs().count() == 30
    u, r = store.runs(), store.results()
    more = [(0, "r", "c1", "c2", "b9", "new", 2, 9 * 86_400_000, [])]
    ids = store.record(*frames(spark, more, [(0, 0, "x.s", "t1", "t1", "failed", 1, "m", None, "f1")])).select(F.col("id").alias("run_id")).cache()
    assert told(store.run_facts(ids, store.last)) == told(facts(store.runs(), store.results(), run_ids=ids))
    assert u.count() == 30 and r.count() == len(before)


def test_an_old_store_opens_and_is_brought_up(spark, tmp_path):
    runs, results = history(11, 20)
    runs = [(*x[:5], f"ci{x[0]}", *x[6:]) for x in runs]
    root = tmp_path / "h"
    u, r = frames(spark, runs, results)
    for batch, ids in (("0a", range(1, 11)), ("1b", range(11, 21))):
        some = F.col("id").isin(*ids)
        u.where(some).drop("changed_files").write.parquet(f"{root}/runs/batch={batch}")
        r.where(F.col("run_id").isin(*ids)).write.parquet(f"{root}/results/batch={batch}")
        (root / "commits").mkdir(exist_ok=True)
        (root / "commits" / batch).touch()
    store = HistoryStore(spark, str(root))
    assert store.live() == {"0a": 1, "1b": 1} and store.runs().count() == 20 and all(x.changed_files == [] for x in store.runs().collect())
    assert store.results().drop("part").count() == len(results)
    more = [(0, "r", "c1", "c2", "b9", "new", 2, 9 * 86_400_000, [])]
    ids = store.record(*frames(spark, more, [(0, 0, "x.s", "t1", "t1", "failed", 1, "m", None, "f1")])).select(F.col("id").alias("run_id")).cache()
    want = told(facts(store.runs(), store.results(), run_ids=ids))
    assert told(store.run_facts(ids, store.last)) == want and sorted(store.live().values()) == [1, 1, 2]
    last = store.last
    store.compact()
    store.vacuum()
    assert set(store.live().values()) == {2} and store.results().count() == len(results) + 1 and last not in store.live()
    (root / "commits" / "ff.v9").touch()
    with pytest.raises(StoreVersionError) as e:
        store.runs()
    assert e.value.code == "history_io"
