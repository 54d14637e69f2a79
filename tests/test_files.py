import io
import os
import random
import zipfile

import pytest

from testweave.sources import files
from testweave.sources.files import contents, discover, leads_into, member, placed
from testweave.sources.reports import read_reports

ONE = "<testsuite name='s'><testcase name='{}'/></testsuite>"


def tree(root, *names):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(ONE.format(n))


@pytest.mark.parametrize("frontier", [4096, 3])
def test_finds_what_matches_and_enters_nothing_else(spark, tmp_path, monkeypatch, frontier):
    monkeypatch.setattr(files, "FRONTIER", frontier)
    tree(tmp_path, "junit.xml", "packages/web/build/test-results/test/TEST-Bar.xml", "reports/junit-results.xml", "target/surefire-reports/TEST-com.acme.FooTest.xml", "a/b/c/d/e/junit-deep.xml", "reports/other.xml", "reports/junit.txt", "dist/junit.xml")
    for skipped in ("node_modules/x", ".git", "a/venv/y", "a/__pycache__"):
        (tmp_path / skipped).mkdir(parents=True)
        os.mkfifo(tmp_path / skipped / "junit.xml")  # whoever reads it waits for ever
    found = lambda *p: sorted(r.path for r in discover(spark, str(tmp_path), *p).collect())
    assert found() == ["a/b/c/d/e/junit-deep.xml", "dist/junit.xml", "junit.xml", "packages/web/build/test-results/test/TEST-Bar.xml", "reports/junit-results.xml", "target/surefire-reports/TEST-com.acme.FooTest.xml"]
    assert found(("reports/*.xml",)) == ["reports/junit-results.xml", "reports/other.xml"]
    assert found(("**/*.tap",)) == [] and found(("junit.xm?",)) == ["junit.xml"] and found(("junit.x?",)) == []
    assert found(("junit.xml", "**/junit.xml")) == ["dist/junit.xml", "junit.xml"]
    assert discover(spark, str(tmp_path / "nowhere")).count() == 0
    rows = read_reports(spark, str(tmp_path)).collect()
    assert sorted(r.path for r in rows) == found() and all(r.name == r.path and r.error is None for r in rows)


def test_wide_folders(spark, tmp_path):
    tree(tmp_path, *(f"d{i}/e{i % 3}/junit-{i}.xml" for i in range(60)))
    assert discover(spark, str(tmp_path)).count() == 60
    assert sorted(r.path for r in discover(spark, f"file://{tmp_path}").collect()) == sorted(f"d{i}/e{i % 3}/junit-{i}.xml" for i in range(60))


def test_folders_that_a_pattern_leads_into():
    assert leads_into("reports", ("reports/*.xml",)) and not leads_into("reports/a", ("reports/*.xml",)) and not leads_into("src", ("reports/*.xml",))
    assert leads_into("x/y/z", ("**/junit.xml",)) and leads_into("x/y", ("x/**/z/*.xml",)) and not leads_into("w/y", ("x/**/z/*.xml",))
    assert leads_into("r1", ("r?/a/*.xml",)) and leads_into("r1/a", ("r?/a/*.xml",)) and not leads_into("r1/b", ("r?/a/*.xml",))


def test_members_are_read_by_their_range(spark, tmp_path):
    rng = random.Random(1)
    texts = {f"m{i}/r{i}.xml": ONE.format(f"t{i}") + "<!--" + "".join(rng.choice("abc é") for _ in range(rng.randint(0, 3000))) + "-->" for i in range(40)}
    with zipfile.ZipFile(tmp_path / "reports.zip", "w") as z:
        for i, (n, t) in enumerate(texts.items()):
            z.writestr(zipfile.ZipInfo(n), t, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
        z.writestr("folder/", "")
        z.writestr("notes.txt", "x")
        z.writestr("odd.xml", ONE.format("odd"), zipfile.ZIP_BZIP2)
        z.writestr("bad.xml", "<testsuite")
    (tmp_path / "no.zip").write_bytes(b"not an archive")
    (tmp_path / "cut.zip").write_bytes((tmp_path / "reports.zip").read_bytes()[:-30])
    (tmp_path / "junit-é.xml").write_text(ONE.format("plain"))
    rows = placed(discover(spark, str(tmp_path), ("*.zip", "*.xml")), str(tmp_path))
    by = {r.path: r for r in rows.collect()}
    assert len(by) == 40 + 2 + 2 + 1 and by["no.zip"].error.startswith("bad archive") and by["cut.zip"].error and by["junit-é.xml"].start is None
    with open(tmp_path / "reports.zip", "rb") as f:
        for n, t in texts.items():
            r = by[f"reports.zip!{n}"]
            assert member(f, r.start, r.packed, r.method).decode() == t
    parsed = read_reports(spark, str(tmp_path), ("*.zip", "*.xml")).collect()
    assert sorted(r.name for r in parsed if r.error is None) == sorted([*(f"t{i}" for i in range(40)), "plain"])
    assert {r.path: r.error.split(":")[0] for r in parsed if r.error} == {"no.zip": "bad archive", "cut.zip": "bad archive", "reports.zip!odd.xml": "bad archive", "reports.zip!bad.xml": "no test suite in it"}


def test_a_member_that_is_not_there():
    with pytest.raises(ValueError):
        member(io.BytesIO(b"x" * 100), 3, 5, 0)


def test_a_file_that_goes_away(spark, tmp_path):
    rows = spark.createDataFrame([("gone.xml", "gone.xml", None, None, None, None)], files.PLACED).toArrow().to_batches()[0]
    (path, data, error), = contents(str(tmp_path), rows)
    assert (path, data) == ("gone.xml", None) and error.startswith("cannot be read")
