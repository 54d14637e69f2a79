import json

from pyspark.sql import functions as F

from testweave.operators import report as P
from testweave.schema import RESULTS, RUNS

DIFF = "diff --git a/x.py b/x.py\n@@ -1 +1 @@\n+x\ndiff --git a/src/y z.py b/src/y z.py\n@@ -1 +1 @@\n+y\ndiff --git a/w.py b/w.py\n@@ -1 +1 @@\n+w"


def runs(spark):
    rows = [(1, "r", "abc", None, None, None, 2, 5, [f"f{i}.py" for i in range(103)]), (2, "r", "def", "abc", "main", None, 1, 6, []), (3, "r", "fed", "abc", "main", None, 1, 6, None)]
    return spark.createDataFrame(rows, RUNS)


def test_focused_diff(spark):
    rows = [(1, DIFF, ["w.py", "src\\y z.py", "none.py"]), (2, DIFF, ["none.py"]), (3, DIFF, None), (4, "", ["w.py"]), (5, None, ["w.py"])]
    got = {r.id: r.d for r in spark.createDataFrame(rows, "id int, diff string, paths array<string>").select("id", P.focused_diff(F.col("diff"), F.col("paths")).alias("d")).collect()}
    assert got[1].startswith("diff --git a/src/y z.py") and got[1].endswith(DIFF) and got[1].count("+w") == 2 and got[1].count("+x") == 1
    assert got[1].split("\n")[3] == "diff --git a/w.py b/w.py"
    assert (got[2], got[3], got[4], got[5]) == (DIFF, DIFF, "", None)


def test_payloads(spark):
    items = spark.createDataFrame([(1, i, f"item {i}", 10) for i in range(20)] + [(2, 5, "only", 10)], "run_id long, id long, item string, tokens int")
    diffs = spark.createDataFrame([(1, DIFF, ["w.py"])], "run_id long, diff string, paths array<string>")
    got = {r.run_id: r for r in P.payloads(runs(spark), items, diffs, diff_lines=4).collect()}
    assert set(got) == {1, 2}
    one = got[1].payload.split("\n")
    assert one[:6] == ["# run", "commit: abc", "parent: (none)", "branch: (none)", "attempt: 2", "changed files: 103"]
    assert one[105] == "  - f99.py" and one[106] == "  … 3 more files" and one[108] == "# open failures: 15"
    assert "item 14" in one and "item 15" not in one and (got[1].taken, got[1].omitted) == (15, 5)
    assert one[-9:] == ["", "# diff", "diff --git a/w.py b/w.py", "@@ -1 +1 @@", "+w", "diff --git a/x.py b/x.py", "… 8 more lines", "", "(5 failures are not in this batch)"]
    assert got[1].tokens == -(-len(got[1].payload) // 4)
    assert got[2].payload.endswith("# open failures: 1\n\nonly") and "diff" not in got[2].payload and got[2].omitted == 0
    cut = {r.run_id: (r.taken, r.omitted) for r in P.payloads(runs(spark), items, most=15, budget=45).collect()}
    assert cut == {1: (4, 16), 2: (1, 0)}
    none = P.payloads(runs(spark), items, budget=5).collect()
    assert {r.run_id: (r.taken, r.omitted) for r in none} == {1: (0, 20), 2: (0, 1)} and all("# open failures: 0\n\n(" in r.payload for r in none)


def test_run_reports(spark):
    results = spark.createDataFrame([(i, 1 + i % 2, "s", f"t{i}", f"t{i}", ["passed", "failed", "skipped"][i % 3], 1, None, None, None) for i in range(9)], RESULTS)
    rows = [(10 + i, 1, f"k{i}", "flake_likely" if i else "real_regression", "medium", ["a", "b", "c"]) for i in range(5)]
    v = spark.createDataFrame(rows, "id long, run_id long, test_key string, kind string, confidence string, evidence array<string>")
    got = {r.run_id: json.loads(r.report) for r in P.run_reports(runs(spark), results, v, most=3).collect()}
    assert set(got) == {1, 2} and got[2]["totals"] == {"passed": 1, "skipped": 1, "failures": 2, "regressions": 0, "flaky": 0} and got[2]["buckets"]["needs_you"] == {"n": 0, "more": 0, "first": []}
    one = got[1]["buckets"]
    assert one["needs_you"]["first"] == [{"test": "k0", "kind": "real_regression", "confidence": "medium", "evidence": ["a", "b"]}]
    assert (one["safe_to_ignore"]["n"], one["safe_to_ignore"]["more"]) == (4, 1) and [x["test"] for x in one["safe_to_ignore"]["first"]] == ["k1", "k2", "k3"]
    assert got[1]["run"]["changed_files"] == 103 and got[1]["totals"]["flaky"] == 4
