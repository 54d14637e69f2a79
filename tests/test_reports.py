import json
import zipfile

import pytest
from pyspark.sql import functions as F

from testweave.sources import reports as R

XML = """<?xml version="1.0"?><testsuites><testsuite name="outer"><testsuite name="inner"><testcase name="deep" time="1,000.0005"/></testsuite>
<testcase classname=" ./a\\\\b//C " name=" first " time="0.25" file="a.py"><failure message="m &lt;1&gt;&#10;x" type="T">at f (<a.py:3) &amp;lt; if a < b</failure></testcase>
<testcase name=""><error/><failure type="X"><![CDATA[body </failure> <b>]]></failure></testcase>
<testcase name="s"><skipped message="later"/></testcase><testcase name="s2"><skipped> because </skipped></testcase>
<testcase name="flaky"><flakyFailure message="once"><stackTrace>at g</stackTrace><system-out>noise</system-out></flakyFailure></testcase></testsuite></testsuites>"""
JSON = {"config": {}, "suites": [{"title": "f", "specs": [{"title": "t", "file": "a/x.spec.ts", "tests": [{"status": "flaky", "results": [{"status": "failed", "duration": 5, "error": {"message": "\x1b[31mError: boom\x1b[0m\nmore", "stack": None}}, {"status": "passed", "duration": 7}]}]}], "suites": [{"title": "group", "specs": [{"title": "u", "file": "a/x.spec.ts", "tests": [{"status": "unexpected", "results": [{"status": "timedOut", "errors": [{"message": "late"}]}]}, {"status": "skipped", "annotations": [{"type": "fixme", "description": " soon "}]}, {"status": "unexpected", "results": [{"status": "passed"}]}]}]}]}]}


def test_xml():
    rows = R.parse_xml("﻿" + XML)
    assert [r["name"] for r in rows] == ["first", "<unnamed>", "s", "s2", "flaky", "deep"]
    assert rows[0]["failure"] == {"message": "m <1>\nx", "type": "T", "stack": "at f (<a.py:3) &lt; if a < b"} and rows[0]["status"] == "failed"
    assert rows[1]["status"] == "error" and rows[1]["failure"] == {"message": None, "type": "X", "stack": "body </failure> <b>"} and rows[1]["suite"] == "outer"
    assert (rows[2]["skip_reason"], rows[3]["skip_reason"]) == ("later", "because")
    assert rows[4]["status"] == "passed" and rows[4]["retries"] == [{"message": "once", "type": None, "stack": "at g"}]
    assert rows[5]["suite"] == "inner" and R.parse_xml("<testsuites><testcase name='x'/></testsuites>")[0]["suite"] == "<unknown-suite>"
    assert R.parse_xml("<testsuite><testcase name='x'><failure/></testcase></testsuite>")[0]["failure"] is None


def test_entities():
    assert R.decode_entities("&#65;&#x42;&lt;&amp;lt;&copy;&#1114112;") == "AB<&lt;&copy;\ufffd"


@pytest.mark.parametrize("text", ["", "  ", "plain", "<html></html>", "<testsuite><testcase name='a'>", "<<<<<<< HEAD\n"])
def test_bad_xml(text):
    with pytest.raises(R.ReportError):
        R.parse_xml(text)


def test_json():
    rows = R.parse_browser_json(json.dumps(JSON))
    assert [(r["name"], r["status"]) for r in rows] == [("t", "passed"), ("group › u", "error"), ("group › u", "skipped"), ("group › u", "failed")]
    assert rows[0]["ms"] == 12 and rows[0]["retries"] == [{"message": "boom", "type": None, "stack": "Error: boom\nmore"}]
    assert rows[1]["failure"]["message"] == "late" and rows[2]["skip_reason"] == "soon" and rows[3]["failure"]["message"] == "expected to fail, but passed"
    for bad in ("{", "[]", "{}"):
        with pytest.raises(R.ReportError):
            R.parse_browser_json(bad)


def test_read(spark, tmp_path):
    (tmp_path / "x/node_modules").mkdir(parents=True)
    (tmp_path / "x/junit-a.xml").write_text(XML)
    (tmp_path / "x/node_modules/junit.xml").write_text(XML)
    (tmp_path / "x/other.xml").write_text(XML)
    (tmp_path / "x/junit-bad.xml").write_text("oops")
    with zipfile.ZipFile(tmp_path / "x/all.zip", "w") as z:
        z.writestr("r.json", json.dumps(JSON))
        z.writestr("r.txt", "no")
    (tmp_path / "x/broken.zip").write_bytes(b"PK no")
    rows = R.read_reports(spark, str(tmp_path), (*R.PATTERNS, "**/*.zip"))
    got = {(r.path, r.ordinal) for r in rows.collect()}
    assert {p for p, _ in got} == {"x/junit-a.xml", "x/junit-bad.xml", "x/all.zip!r.json", "x/broken.zip"} and len(got) == 12
    done = R.analyzed(rows)
    first = done.where("name = 'first'").first()
    assert first.suite == "a/b/C" and first.duration_ms == 250 and len(first.fingerprint) == 16 and len(first.test_key) == 64
    assert done.where("name = 'deep'").first().duration_ms == 1_000_001 and done.where("status = 'passed' and fingerprint is not null").count() == 0
    assert rows.where(F.col("error").isNotNull()).count() == 2


def test_diff(spark):
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,2 @@ f\n-a\n-b\n+c\n+d\n@@ -9 +11,0 @@\n-z\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-q\n+++ b/y.py\n@@ -0,0 +1 @@\n+n\n"
    got = [(r.ordinal, r.file, r.new_start, r.new_lines, r.changed_lines) for r in R.parse_diff(spark.createDataFrame([(1, diff), (2, None)], "change long, diff string")).collect()]
    assert got == [(0, "x.py", 3, 2, [3, 4]), (1, "x.py", 11, 0, []), (2, "y.py", 1, 1, [1])]
