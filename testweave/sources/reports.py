"""Report sources: XML and browser-runner JSON files, plain or zipped, to rows of test results.

Spark lists and reads the files and deals them out; a task parses one file at a time. A file that doesn't parse becomes
one row with ``error`` set, so nothing fails and nothing is lost; ``ordinal`` keeps the document's order.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BrowserReportError, EmptyReportError, ReportParseError
from ..functions import keys as K
from ..functions.text import normalize_failure
from ..schema import HUNKS, PARSED
from .files import PATTERNS, contents, dealt, discover, placed, rooted

#: Elements whose content is text, whatever it holds.
_OPAQUE = ("failure", "error", "flakyFailure", "flakyError", "rerunFailure", "rerunError", "system-out", "system-err", "skipped")
_RETRIES = ("flakyFailure", "flakyError", "rerunFailure", "rerunError")
_TAG = re.compile(r"<!\[CDATA\[.*?\]\]>|<!--.*?-->|<[?!][^>]*>|<(/?)([A-Za-z_][\w.:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([\w.:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_ANSI = re.compile("\x1b\\[[0-9;]*[A-Za-z]")


#: A report that cannot be read.
ReportError = ReportParseError


def _character(code: int) -> str:
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def decode_entities(s: str) -> str:
    """Numeric references, then the five named ones, the ampersand last; other names stay as they are."""
    s = re.sub(r"&#([0-9]+);", lambda m: _character(int(m[1])), s)
    s = re.sub(r"&#x([0-9A-Fa-f]+);", lambda m: _character(int(m[1], 16)), s)
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        s = s.replace(f"&{name};", c)
    return s


def clean_body(raw: str | None) -> str | None:
    """Text of an opaque element: entities decoded, captured output and wrappers dropped; blank is none."""
    if raw is None:
        return None
    parts, at = [], 0
    for m in re.finditer(r"<!\[CDATA\[(.*?)(?:\]\]>|\Z)", raw, re.DOTALL):
        parts += [decode_entities(raw[at : m.start()]), m[1]]
        at = m.end()
    text = "".join(parts) + decode_entities(raw[at:])
    text = re.sub(r"<system-(out|err)>.*?</system-\1>|<system-(?:out|err)\s*/>|</?stackTrace>", "", text, flags=re.DOTALL | re.IGNORECASE)
    return text.strip() or None


def _events(text: str) -> Iterator[tuple[str, str, dict, str | None]]:
    """(open or close, tag, attributes, opaque body) in document order; bodies of failures and output are never parsed."""
    at = 0
    while m := _TAG.search(text, at):
        at = m.end()
        if not m[2]:
            continue
        if m[1]:
            yield "close", m[2], {}, None
            continue
        attributes = {k: decode_entities(a or b) for k, a, b in _ATTRIBUTE.findall(m[3])}
        body = None
        if m[2] in _OPAQUE and not m[4]:
            end = re.compile(rf"</{re.escape(m[2])}\s*>").search(text, at)
            # a closing tag inside a CDATA section doesn't count
            inside = re.compile(rf"\s*<!\[CDATA\[.*?\]\]>\s*</{re.escape(m[2])}\s*>", re.DOTALL).match(text, at)
            end_at = inside.end() if inside else end.end() if end else len(text)
            body = re.sub(rf"</{re.escape(m[2])}\s*>\Z", "", text[at:end_at])
            at = end_at
        yield "open", m[2], attributes, body
        if m[4] or m[2] in _OPAQUE:
            yield "close", m[2], {}, None


def _failure(attributes: dict, body: str | None) -> dict:
    stack = clean_body(body)
    kind = attributes.get("type")
    return {"message": attributes.get("message", None if stack else kind), "type": kind, "stack": stack}


def _case(attributes: dict, suite: str | None, inner: list[tuple[str, dict, str | None]]) -> dict:
    found = [(t, _failure(a, b)) for t, a, b in inner if t in _OPAQUE[:6]]
    told = [(t, f) for t, f in found if any(f.values())]
    first = [f for t, f in told if t == "failure"] + [f for t, f in told if t == "error"]
    kinds = {t for t, _ in found}
    row = {"suite": (attributes.get("classname") or "").strip() or suite or "<unknown-suite>", "name": (attributes.get("name") or "").strip() or "<unnamed>", "file": attributes.get("file"), "time": attributes.get("time"), "failure": None, "skip_reason": None}
    row["retries"] = [f for k in _RETRIES for t, f in told if t == k]
    if "error" in kinds:
        row["status"], row["failure"] = "error", next((f for f in first if f["type"] is not None or f["stack"] is not None), first[0] if first else None)
    elif "failure" in kinds:
        row["status"], row["failure"] = "failed", first[0] if first else None
    elif skip := next(((a, b) for t, a, b in inner if t == "skipped"), None):
        row["status"], row["skip_reason"] = "skipped", clean_body(skip[1]) or skip[0].get("message") or "skipped"
    else:
        row["status"] = "passed"
    return row


def parse_xml(text: str) -> list[dict]:
    """Test cases of an XML report: a suite's own cases, then its nested suites, each with the nearest suite's name."""
    text = text.removeprefix("﻿")
    if not text.strip():
        raise EmptyReportError("empty report")
    root = {"name": None, "cases": [], "suites": []}
    stack, case, seen, depth = [root], None, False, 0
    for kind, tag, attributes, body in _events(text):
        if tag == "testsuite" and case is None:
            seen = True
            if kind == "open":
                node = {"name": attributes.get("name", stack[-1]["name"]), "cases": [], "suites": []}
                stack[-1]["suites"].append(node)
                stack.append(node)
            elif len(stack) > 1:
                stack.pop()
            else:
                raise ReportError("malformed XML")
        elif tag == "testsuites":
            depth += 1
        elif tag == "testcase":
            if kind == "open":
                case = (attributes, [])
            elif case is not None:
                seen = seen or depth > 0
                stack[-1]["cases"].append(_case(case[0], stack[-1]["name"], case[1]))
                case = None
        elif case is not None and kind == "open":
            case[1].append((tag, attributes, body))
    if not seen:
        raise ReportError("no test suite in it")
    if len(stack) > 1 or case is not None:
        raise ReportError("malformed XML")

    def walk(node):
        yield from node["cases"]
        for s in node["suites"]:
            yield from walk(s)

    # suites of the wrapper come before cases that stand directly in it
    return [c for s in root["suites"] for c in walk(s)] + root["cases"]


def _attempt(result: dict) -> dict:
    plain = lambda t: (_ANSI.sub("", t).strip() or None) if isinstance(t, str) else None
    error = result.get("error") or next(iter(result.get("errors") or []), {})
    text = plain(error.get("message"))
    line = text.splitlines()[0].strip() if text else None
    return {"message": re.sub(r"^Error:\s*", "", line) if line else None, "type": None, "stack": plain(error.get("stack")) or text}


def parse_browser_json(text: str) -> list[dict]:
    """Tests of a browser runner's JSON report: specs of a suite, then its child suites, whose titles lead the names."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise BrowserReportError("malformed JSON") from e
    if not isinstance(doc, dict) or not isinstance(doc.get("config"), dict) or not isinstance(doc.get("suites"), list):
        raise BrowserReportError("not a browser-runner report")
    out = []

    def walk(suite, path):
        for spec in suite.get("specs") or []:
            for test in spec.get("tests") or []:
                results = test.get("results") or []
                bad = [r for r in results if r.get("status") in ("failed", "timedOut", "interrupted")]
                kind = test.get("status")
                late = bool(results) and results[-1].get("status") in ("timedOut", "interrupted")
                status = "skipped" if kind == "skipped" else "passed" if kind in ("expected", "flaky") else "error" if late else "failed"
                note = next((a for a in test.get("annotations") or [] if a.get("type") in ("skip", "fixme")), {})
                failure = None
                if status in ("failed", "error"):
                    failure = _attempt(bad[-1]) if bad else {"message": "expected to fail, but passed", "type": None, "stack": None}
                out.append({"suite": spec.get("file") or "<unknown-file>", "name": " › ".join([*path, spec.get("title") or "<unnamed>"]), "status": status, "file": None, "ms": sum(r.get("duration") or 0 for r in results) if results else None, "failure": failure, "skip_reason": ((note.get("description") or "").strip() or "skipped") if status == "skipped" else None, "retries": [_attempt(r) for r in bad] if kind == "flaky" else []})
        for child in suite.get("suites") or []:
            walk(child, [*path, child.get("title") or ""])

    for s in doc["suites"]:
        walk(s, [])
    return out


def _entries(path: str, content: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """The reports in a file: itself, or the members of a zip archive; (path, bytes, error)."""
    if not path.lower().endswith(".zip"):
        yield path, content, None
        return
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                if not i.is_dir() and i.filename.lower().endswith((".xml", ".json")):
                    yield f"{path}!{i.filename}", z.read(i), None
    except (zipfile.BadZipFile, NotImplementedError, EOFError, RuntimeError) as e:
        yield path, None, f"bad archive: {e}"


_CASE = pa.struct([(n, pa.string()) for n in ("message", "type", "stack")])
_RAW = pa.schema([("path", pa.string()), ("ordinal", pa.int32()), ("suite", pa.string()), ("name", pa.string()), ("status", pa.string()), ("time", pa.string()), ("ms", pa.int64()), ("file", pa.string()), ("failure", _CASE), ("skip_reason", pa.string()), ("retries", pa.list_(_CASE)), ("error", pa.string())])
_RAW_SPARK = "path string, ordinal int, suite string, name string, status string, time string, ms long, file string, failure struct<message:string,type:string,stack:string>, skip_reason string, retries array<struct<message:string,type:string,stack:string>>, error string"


def _cases(entries: Iterator[tuple[str, bytes | None, str | None]]) -> Iterator[dict]:
    """A row per test case of each report, or one with its error."""
    for name, data, error in entries:
        try:
            if error:
                raise ReportError(error)
            text = data.decode("utf-8", "replace")
            cases = parse_browser_json(text) if name.lower().endswith(".json") else parse_xml(text)
            yield from ({"path": name, "ordinal": i, **c} for i, c in enumerate(cases))
        except ReportParseError as e:
            yield {"path": name, "error": str(e)}


def _parsed(rows: DataFrame) -> DataFrame:
    out = rows.withColumns({"suite": K.stable_suite(F.col("suite")), "duration_ms": F.coalesce("ms", K.time_to_ms(F.col("time")))})
    return out.select(*(F.col(f.name).cast(f.dataType) for f in PARSED.fields))


def parse_files(files: DataFrame) -> DataFrame:
    """Rows of results for files (path, content): one per test case, or one with ``error`` for a file that cannot be read."""

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                yield pa.RecordBatch.from_pylist(list(_cases(_entries(path, content))), schema=_RAW)

    return _parsed(files.select("path", "content").mapInArrow(run, _RAW_SPARK))


def read_reports(spark: SparkSession, root: str, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """Results of all report files under ``root`` whose path below it matches a pattern (zip archives and JSON included by name).

    Files are found and read in tasks, one report (or archive's member) at a time; see :mod:`testweave.sources.files`.
    """
    root = rooted(root)

    def run(batches):
        for b in batches:
            for entry in contents(root, b):
                yield pa.RecordBatch.from_pylist(list(_cases(iter([entry]))), schema=_RAW)

    return _parsed(dealt(placed(discover(spark, root, patterns), root)).mapInArrow(run, _RAW_SPARK))


def analyzed(parsed: DataFrame, repo_root: str | None = None) -> DataFrame:
    """Parsed results with test_key and, for failures, their fingerprint."""
    canonical = normalize_failure(F.col("failure.message"), F.col("failure.stack"), repo_root)["canonical"]
    print_ = F.when(K.failing(F.col("status")) & F.col("failure").isNotNull(), K.fingerprint(canonical))
    return parsed.where(F.col("error").isNull()).withColumns({"test_key": K.test_key(F.col("suite"), F.col("name")), "fingerprint": print_})


def parse_diff(diffs: DataFrame) -> DataFrame:
    """Hunks of unified diffs without context (change, diff): file, first new line, number of new lines, the added lines."""

    def run(batches):
        schema = pa.schema([("change", pa.int64()), ("ordinal", pa.int32()), ("file", pa.string()), ("new_start", pa.int32()), ("new_lines", pa.int32()), ("changed_lines", pa.list_(pa.int32()))])
        for b in batches:
            rows = []
            for change, text in zip(b["change"].to_pylist(), b["diff"].to_pylist()):
                file, hunk, place, n = None, None, 0, 0
                for line in (text or "").splitlines():
                    if line.startswith("+++ "):
                        file, hunk = (line[6:] if line.startswith("+++ b/") else None), None
                    elif m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line):
                        if file:
                            hunk = {"change": change, "ordinal": n, "file": file, "new_start": int(m[1]), "new_lines": int(m[2] or 1), "changed_lines": []}
                            rows.append(hunk)
                            place, n = int(m[1]), n + 1
                    elif hunk and line.startswith("+"):
                        hunk["changed_lines"].append(place)
                        place += 1
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return diffs.select(F.col("change").cast("long").alias("change"), "diff").mapInArrow(run, "change long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in HUNKS.fields))
