"""Identity of a test: canonical suite, key, fingerprint; outcomes of a status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAILING = ("failed", "error")
_EDGE = "^[\\s\\u00a0\\ufeff]+|[\\s\\u00a0\\ufeff]+\\z"


def trimmed(c: Column) -> Column:
    """Both ends freed of any white space (Spark's own trim knows blanks only)."""
    return F.regexp_replace(c, _EDGE, "")


def stable_suite(raw: Column) -> Column:
    """Trimmed, forward slashes, no doubled ones, no leading ``./``."""
    slashed = F.regexp_replace(F.replace(trimmed(raw), F.lit("\\"), F.lit("/")), "/{2,}", "/")
    return F.regexp_replace(slashed, "^\\./", "")


def test_key(suite: Column, name: Column) -> Column:
    return F.sha2(F.concat(suite, F.lit("::"), name), 256)


def packed_key(key: Column) -> Column:
    """A key as bytes for a shuffle: digests in lower-case hex take half their length, others stay as they are; the first byte tells which."""
    return F.when(key.rlike("\\A(?:[0-9a-f]{2})+\\z"), F.concat(F.lit(b"\1"), F.unhex(key))).otherwise(F.concat(F.lit(b"\0"), key.cast("binary")))


def unpacked_key(packed: Column) -> Column:
    rest = F.substring(packed, 2, 2**31 - 1)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\1"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def fingerprint(canonical: Column) -> Column:
    return F.substring(F.sha2(canonical, 256), 1, 16)


def failing(status: Column) -> Column:
    return status.isin(*FAILING)


def settled(status: Column) -> Column:
    """pass or fail; null for skipped (flakiness leaves skips out)."""
    return F.when(status == "passed", "pass").when(failing(status), "fail")


def strict(status: Column) -> Column:
    """pass or fail, where all that didn't pass failed (the classifier's timeline)."""
    return F.when(status == "passed", "pass").otherwise("fail")


def rollup(status: Column) -> Column:
    """One status for the rows of a group: failed, else error, else passed, else skipped."""
    has = lambda s: F.coalesce(F.bool_or(status == s), F.lit(False))
    return F.when(has("failed"), "failed").when(has("error"), "error").when(has("passed"), "passed").otherwise("skipped")


def status_of(has_error: Column, has_failure: Column, has_skipped: Column) -> Column:
    """Status of a report's test case from the elements it holds."""
    return F.when(has_error, "error").when(has_failure, "failed").when(has_skipped, "skipped").otherwise("passed")


def browser_status(status: Column, last_attempt: Column) -> Column:
    """Status of a browser-runner test from its own status and its last attempt's."""
    late = last_attempt.isin("timedOut", "interrupted")
    return F.when(status == "skipped", "skipped").when(status.isin("expected", "flaky"), "passed").when(late, "error").otherwise("failed")


def time_to_ms(raw: Column) -> Column:
    """Seconds as text to whole milliseconds, halves up; empty is 0, anything but a number is null."""
    text = trimmed(F.replace(raw, F.lit(","), F.lit("")))
    seconds = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    finite = ~F.isnan(seconds) & (F.abs(seconds) < F.lit(float("inf")))
    return F.when(finite, F.floor(seconds * 1000 + 0.5)).cast("long")


def join_files(files: Column) -> Column:
    return F.array_join(files, "\n")


def split_files(text: Column) -> Column:
    """Newline-joined file names as an array, trimmed, blanks dropped; null is empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trimmed), lambda x: x != "")


def distinct_files(files: Column) -> Column:
    """Each file once, where it first stands; null is empty."""
    return F.array_distinct(F.coalesce(files, F.array().cast("array<string>")))


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def repo_slug(remote: Column) -> Column:
    """owner/name of a git remote address, else null."""
    return F.nullif(F.regexp_extract(F.regexp_replace(remote, "\\.git/?\\z", ""), "[:/]([^/:]+/[^/:]+)/?\\z", 1), F.lit(""))


def glob_to_regex(glob: str) -> str:
    """Path pattern to an anchored regular expression: ``**/`` any folders, ``**`` anything, ``*`` within a segment, ``?`` one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "_/-" else "\\" + c
            i += 1
    return "^" + out + "\\z"


def artifact_regex(glob: str) -> str:
    """Artifact-name pattern: ``*`` is anything, ``?`` one character, letters in either case."""
    wild = {"*": ".*", "?": "."}
    return "(?is)^" + "".join(wild.get(c) or (c if c.isalnum() or c in "_-" else "\\" + c) for c in glob) + "\\z"
