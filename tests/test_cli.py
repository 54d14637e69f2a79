import json

from testweave import cli

XML = "<testsuite name='s'><testcase name='a'/><testcase name='b' classname='pkg.B'>{}</testcase></testsuite>"


def test_end_to_end(spark, tmp_path, capsys):
    reports = tmp_path / "reports"
    reports.mkdir()
    store = ["--store", str(tmp_path / "store")]
    bad = "<failure message='AssertionError: expected 1'>at f (src/pay.py:3:1)</failure>"
    codes = []
    for i, body in enumerate(("", bad)):
        (reports / "junit.xml").write_text(XML.format(body))
        codes.append(cli.main([*store, "run", str(reports), "--commit", f"c{i}", "--parent", f"c{i - 1}", "--ci-run", str(i), "--changed", "src/pay.py", "--fail-on", "regression", "--format", "markdown"]))
    out = capsys.readouterr().out
    assert codes == [0, 1] and "real_regression (medium)" in out
    assert cli.main([*store, "explain", "b"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["verdict"]["kind"] == "real_regression" and found["flips"]["flips"] == 1 and found["test"]["suite"] == "pkg.B" and len(found["timeline"]) == 2
    assert cli.main([*store, "explain", "b", "--format", "text"]) == 0
    text = capsys.readouterr().out
    assert text.startswith("pkg.B › b\n") and "verdict: real_regression (medium)" in text and "timeline (oldest first):" in text and "at f (src/pay.py:3:1)" in text
    assert cli.main([*store, "explain", "nothing-like-it"]) == 2
    (reports / "junit.xml").unlink()
    assert cli.main([*store, "run", str(reports), "--commit", "c9"]) == 2
    assert cli.main([*store, "stats", "--min-runs", "2"]) == 0 and '"flips": 1' in capsys.readouterr().out
