import datetime

from testweave.functions import keys as K
from testweave.operators import classify as C
from testweave.operators import history as H
from testweave.operators import report as P
from testweave.operators.facts import facts
from testweave.schema import RESULTS, RUNS
from testweave.sources.store import HistoryStore, backfill
from testweave.streaming.online import failures_by_window, online_flips, report_stream

from pyspark.sql import functions as F


def history(spark, letters, name="t"):
    """Compact timelines: one letter per run, P, F, E or S."""
    status = {"P": "passed", "F": "failed", "E": "error", "S": "skipped"}
    runs = [(i + 1, "r", f"c{i}", f"c{i - 1}", "main", f"ci{i}", 1, 1000 + i, []) for i in range(len(letters))]
    results = [(i + 1, i + 1, "s", name, name, status[x], 100, "boom" if x in "FE" else None, None, "fp" if x in "FE" else None) for i, x in enumerate(letters)]
    return spark.createDataFrame(runs, RUNS), spark.createDataFrame(results, RESULTS)


def test_flakiness_cases(spark):
    for letters, runs, flips, rate in (("PFPFPF", 6, 5, 1.0), ("PPPFFF", 6, 1, 0.2), ("PSESP", 3, 2, 1.0)):
        r = H.flaky_stats(H.rows_for_flakiness(*history(spark, letters))).first()
        assert (r.n_runs, r.flips, r.flip_rate) == (runs, flips, rate)
    assert H.flaky_stats(H.rows_for_flakiness(*history(spark, "PF"))).count() == 0


def test_facts_see_the_past_only(spark):
    u, r = history(spark, "PFPFFE")
    rows = {x.run_id: x for x in facts(u, r).collect()}
    assert (rows[2].prior_runs, rows[2].ever_passed, rows[2].parent_outcome, rows[2].flips) == (1, True, "pass", 1)
    assert (rows[4].flips, rows[5].flips, rows[5].parent_outcome) == (3, 3, "fail")
    only = {x.run_id: x.flips for x in facts(u, r, window=2).collect()}
    assert only == {2: 1, 4: 1, 5: 0, 6: 0}


def test_rules_in_order(spark):
    base = {"passed_elsewhere": False, "normalized_text": "x", "prior_runs": 3, "ever_passed": True, "flips": 0, "considered": 4, "unexplained": 0, "branches": 1, "fingerprint": "f", "parent_outcome": None, "blame": [], "commit_sha": "abcdefghij", "parent_sha": "p", "attempt": 2}
    link = lambda p: [{"depth": 0, "file": "a.py", "proximity": p, "changed_file": "a.py", "confidence": 0.5}]
    cases = [({"passed_elsewhere": True, "normalized_text": "ECONNREFUSED"}, "flake_confirmed", "high"), ({"normalized_text": "connect econnrefused"}, "infra_failure", "high"), ({"normalized_text": "429 Too Many Requests"}, "ambiguous", "low"), ({"ever_passed": False}, "always_failing", "high"), ({"unexplained": 2, "flips": 2}, "flake_likely", "medium"), ({"branches": 3}, "flake_likely", "medium"), ({"parent_outcome": "pass", "blame": link("same_hunk")}, "real_regression", "high"), ({"parent_outcome": "pass", "blame": link("same_file")}, "real_regression", "medium"), ({"parent_outcome": "pass"}, "ambiguous", "low"), ({"prior_runs": 0, "ever_passed": False}, "ambiguous", "low")]
    schema = "i int, passed_elsewhere boolean, normalized_text string, prior_runs long, ever_passed boolean, flips long, considered long, unexplained long, branches long, fingerprint string, parent_outcome string, blame array<struct<depth:int,file:string,proximity:string,changed_file:string,confidence:double>>, commit_sha string, parent_sha string, attempt int"
    rows = spark.createDataFrame([{"i": i, **base, **c[0]} for i, c in enumerate(cases)], schema)
    got = {r.i: r for r in C.classify(rows).collect()}
    assert [(got[i].kind, got[i].confidence) for i in range(len(cases))] == [c[1:] for c in cases]
    assert all(r.evidence and all(r.evidence) for r in got.values())


def test_store_is_idempotent(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"))
    u, r = history(spark, "PFPF")
    assert store.record(u, r).count() == 4 and store.record(u, r).count() == 0
    assert store.runs().count() == 4 and store.results().count() == 4
    nameless = u.withColumn("ci_run_id", F.lit(None).cast("string"))
    assert store.record(nameless, r).count() == 4
    assert sorted(x.id for x in store.runs().collect()) == list(range(1, 9))
    more, res = history(spark, "PFPFPF")
    done = backfill(store, more, res, cutoff_ms=1003)
    assert done == {"scanned": 6, "out_of_range": 3, "already_recorded": 1, "inserted": 2, "oldest": 5, "stopped": "cutoff"}


def test_passed_after_retry(spark):
    schema = "id int, attempt int, commit_sha string, retries array<struct<message:string,type:string,stack:string>>, attempts array<int>"
    rows = spark.createDataFrame([(1, 2, "abcdefghi", [("\n first \nsecond", None, None)], []), (2, 3, "abcdefghi", [], [1, 2]), (3, 1, "a", [], [])], schema)
    got = {r.id: r.evidence for r in C.classify_passed(rows).collect()}
    assert set(got) == {1, 2} and got[1][0].endswith(": first") and "1, 2" in got[2][0]


def test_report_text(spark):
    v = spark.createDataFrame([(i, f"key{i}", "ambiguous", "low", "history", ["e"]) for i in range(11)] + [(99, "k", "real_regression", "high", "history", ["a", "b", "c"])], "id long, test_key string, kind string, confidence string, source string, evidence array<string>")
    text = P.render(v)
    assert text.startswith(P.MARKER) and "1 regressions" in text and "… and 3 more" in text and text.index("Needs attention") < text.index("Look soon")
    assert P.MARKER not in P.render(v, "text")


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/junit.xml").write_text("<testsuite name='s'><testcase name='a'/><testcase name='b'><failure message='m'/></testcase></testsuite>")
    q = report_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("reports").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("reports").count() == 2
    day = datetime.datetime(2024, 1, 1)
    rows = [(day + datetime.timedelta(hours=h), h % 2, h % 3 == 0) for h in range(40)]
    events = spark.createDataFrame(rows, "ts timestamp, test long, failed boolean")
    events.repartition(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = failures_by_window(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("windows").collect()} == {tuple(r) for r in failures_by_window(events).collect()}
    q = online_flips(stream).writeStream.format("memory").queryName("flips").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    want = {}
    for t in (0, 1):
        o = [f for _, k, f in rows if k == t]
        want[t] = (len(o), sum(a != b for a, b in zip(o, o[1:])))
    assert {r.test: (r.n, r.flips) for r in spark.table("flips").collect()} == want


def test_key_functions(spark):
    f = spark.createDataFrame([(" ./a//b\\c ", "1,234.5", "git@h:o/n.git", "a\n\n b "), ("x", "abc", "https://h/o/n", None), ("", "", "nothing", ""), ("", "-0.0025", None, "q")], "suite string, t string, url string, files string")
    got = f.select(K.stable_suite(F.col("suite")), K.time_to_ms(F.col("t")), K.repo_slug(F.col("url")), K.split_files(F.col("files"))).collect()
    assert [tuple(r) for r in got] == [("a/b/c", 1234500, "o/n", ["a", "b"]), ("x", None, "o/n", []), ("", 0, None, []), ("", -2, None, ["q"])]


def test_explain_counts_a_fingerprint_over_other_tests(spark):
    from testweave.operators.explain import explain

    runs = spark.createDataFrame([(i, "r", f"c{i}", f"p{i}", f"b{i}", str(i), 1, 1000 * i, []) for i in range(1, 6)], "id long, repo string, commit_sha string, parent_sha string, branch string, ci_run_id string, attempt int, started_at long, changed_files array<string>")
    rows = [(i, i, "s", f"t{i}", f"key{i}", "failed", 5, "odd", "", "same") for i in range(1, 5)] + [(10, 5, "s", "t4", "key4", "passed", 5, None, None, None)]
    rows += [(20, 3, "s", "t4", "key4", "passed", 5, None, None, None)]
    results = spark.createDataFrame(rows, "id long, run_id long, suite string, test_name string, test_key string, status string, duration_ms long, message string, stack string, fingerprint string")
    found = explain(runs, results, "t4")
    assert found["verdict"]["kind"] == "flake_likely" and found["spread"]["branches"] == 4


def test_places_within_buckets(spark):
    kinds = ["real_regression", "always_failing", "ambiguous", "infra_failure", "flake_confirmed", "flake_likely"]
    sure = ["high", "medium", "low"]
    rows = [(i * 37 % 1009, kinds[i % 6 if i % 5 else 5], sure[i % 3]) for i in range(700)]
    v = spark.createDataFrame(rows, "id long, kind string, confidence string")
    got = {r.id: (r.bucket, r.place) for r in C.group_by_action(v, slots=8).collect()}
    for b in C.BUCKETS:
        mine = sorted((r for r in rows if C.BUCKET[r[1]] == b), key=lambda r: (C.KINDS.index(r[1]), sure.index(r[2]), r[0]))
        assert [got[r[0]] for r in mine] == [(b, k + 1) for k in range(len(mine))]
    assert C.group_by_action(v.limit(0)).count() == 0 and C.group_by_action(v, most=3).count() == 9


def test_backfill_from_archives(spark, tmp_path):
    import io
    import zipfile

    from testweave.sources.store import backfill_archives

    def archive(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in members.items():
                z.writestr(name.replace("_", "."), text)
        return out.getvalue()

    one = "<testsuite name='s'><testcase name='a' time='1'/><testcase name='b'><failure message='boom'>at x</failure></testcase></testsuite>"
    runs = spark.createDataFrame([(i, "r", f"c{i}", None, "main", f"ci{i}", 1, 1000 + i, []) for i in range(1, 8)], RUNS)
    rows = [
        (2, "junit-1", False, archive(r_xml=one)),
        (3, "junit-2", None, archive(r_xml=one, bad_xml="<testsuite", notes_txt="x")),
        (3, "junit-2b", True, archive(r_xml=one)),
        (4, "junit-3", True, archive(r_xml=one)),
        (5, "logs", False, archive(r_xml=one)),
        (6, "junit-4", False, b"no zip"),
        (7, "junit-5", False, archive(r_xml=one)),
        (1, "junit-6", False, archive(r_xml=one)),
    ]
    artifacts = spark.createDataFrame(rows, "run_id long, name string, expired boolean, content binary")
    store = HistoryStore(spark, str(tmp_path / "h"))
    done = backfill_archives(store, runs, artifacts, "JUnit-?", cutoff_ms=1002, since=7)
    assert done == {"scanned": 6, "matched": 3, "recorded": 2, "already_recorded": 0, "results": 4, "artifacts": 3, "bad_archives": 1, "parse_failures": 1, "oldest": 2, "stopped": "window"}
    assert sorted((r.ci_run_id, r.n) for r in H.joined(store.runs(), store.results()).groupBy("ci_run_id").agg(F.count("*").alias("n")).collect()) == [("ci2", 2), ("ci3", 2)]
    again = backfill_archives(store, runs, artifacts, since=7)
    assert (again["already_recorded"], again["recorded"], again["stopped"]) == (2, 2, "since")
    assert backfill_archives(store, runs.limit(0), artifacts)["stopped"] == "exhausted"


def test_start_hint(spark):
    link = "array<struct<file:string,line:int>>"
    rows = [
        ("real_regression", [("a.py", 3)], "at q (b.ts:9:1)", []),
        ("real_regression", [("a.py", None)], "at q (src\\b.ts:9:1)\nat r (lib/C.go:4)", ["x/c.go"]),
        ("real_regression", [], "at q (src\\b.ts:9:1)\nat r (lib/C.go:4)", None),
        ("real_regression", None, None, ["x/c.go"]),
        ("ambiguous", [("a.py", 3)], "at q (b.ts:9:1)", []),
    ]
    f = spark.createDataFrame(rows, f"kind string, blame {link}, stack string, files array<string>")
    got = [r[0] for r in f.select(P.start_hint(F.col("kind"), F.col("blame"), F.col("stack"), F.col("files"))).collect()]
    assert got == ["a.py:3", "lib/C.go:4", "src/b.ts:9", None, None]


def test_escalation_plan(spark):
    v = spark.createDataFrame([(i, f"k{i}", "ambiguous" if i else "flake_likely", ["e"] * (1 + (i == 5))) for i in range(6)], "id long, test_key string, kind string, evidence array<string>")
    items = spark.createDataFrame([(i, 10 * i) for i in range(6)], "id long, tokens long")
    state = lambda **k: {r.id: r.state for r in C.escalation_plan(v, items, **k).collect()}
    assert state(most=3) == {5: "sent", 1: "sent", 2: "sent", 3: "deferred", 4: "deferred"}
    assert state(most=3, guardrail=79) == {5: "too_large", 1: "too_large", 2: "too_large", 3: "deferred", 4: "deferred"}
    assert C.escalation_plan(v.where("id = 0"), items).count() == 0
