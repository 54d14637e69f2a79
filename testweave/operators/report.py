"""Reports and model payloads from verdict tables.

What grows with the history stays in DataFrames (JSON lines, one per verdict; totals by aggregation); only what is shown,
a bounded number of rows, is collected and laid out as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import PLACE
from ..schema import MODEL_VERDICT
from . import classify as C
from .history import meet

TITLES = {"needs_you": "Needs attention", "look_soon": "Look soon", "safe_to_ignore": "Safe to ignore"}
MARKER = "<!-- test-history-report -->"
#: Limits of a model payload.
MESSAGE_CHARS, STACK_LINES, DIFF_LINES, PAYLOAD_FILES = 2000, 30, 400, 100


def json_lines(verdicts: DataFrame) -> DataFrame:
    """Each verdict as one JSON document (schema version 2)."""
    body = F.struct(F.lit(2).alias("schema_version"), "id", "test_key", "kind", "confidence", C.bucket(F.col("kind")).alias("bucket"), "source", "evidence")
    return verdicts.select("id", F.to_json(body).alias("json"))


def failure_excerpt(stack: Column, most: int = 15) -> Column:
    return T.truncate_lines(stack, most)


def stack_places(stack: Column) -> Column:
    """All ``file:line`` places of a stack, in order."""
    return F.transform(F.regexp_extract_all(stack, F.lit(PLACE), F.lit(0)), _forward)


def _forward(p: Column) -> Column:
    return F.replace(p, F.lit("\\"), F.lit("/"))


def start_at(kind: Column, blame: Column, places: Column, changed_files: Column) -> Column:
    """``file:line`` where to start with a regression: the strongest link's frame, else the stack's first place in a changed file (by name), else its first place."""
    name = lambda p: F.lower(F.element_at(F.split(_forward(p), "/"), -1))
    names = F.transform(F.coalesce(changed_files, F.array().cast("array<string>")), name)
    changed = F.filter(places, lambda p: F.array_contains(names, F.regexp_replace(name(p), ":[0-9]+\\z", "")))
    link = F.get(blame, F.lit(0))
    at = F.when(link["line"].isNotNull(), F.concat(link["file"], F.lit(":"), link["line"]))
    return F.when(kind == "real_regression", F.coalesce(at, F.get(changed, F.lit(0)), F.get(places, F.lit(0))))


def start_hint(kind: Column, blame: Column, stack: Column, changed_files: Column) -> Column:
    """:func:`start_at` from the stack itself."""
    return start_at(kind, blame, stack_places(stack), changed_files)


def render(verdicts: DataFrame, style: str = "markdown", most: int = 8) -> str:
    """A short report: headline, then the first verdicts of each bucket, where to start (column ``hint``, if there is one) and how many more there are."""
    h = C.headline(verdicts).first()
    rows = C.top_of_groups(verdicts, most).withColumn("evidence", F.slice("evidence", 1, 2)).collect()
    md = style == "markdown"
    out = ([MARKER] if md else []) + [f"{'## ' if md else ''}{h['regressions']} regressions, {h['needs_you']} need attention, {h['look_soon']} to look at, {h['flaky']} flaky", ""]
    for b in C.BUCKETS:
        mine = sorted((r for r in rows if r["bucket"] == b), key=lambda r: (C.KINDS.index(r["kind"]), -{"high": 2, "medium": 1, "low": 0}[r["confidence"]], r["id"]))
        if mine:
            out.append(f"{'### ' if md else ''}{TITLES[b]}")
            for r in mine:
                name = r["test_key"][:12] if md else r["test_key"]
                out += [f"- {'`' + name + '`' if md else name}: {r['kind']} ({r['confidence']})", *(f"  {e}" for e in r["evidence"])]
                if "hint" in verdicts.columns and r["hint"]:
                    out.append(f"  → start at {r['hint']}")
            if mine[0]["more"]:
                out.append(f"… and {mine[0]['more']} more")
            out.append("")
    return "\n".join(out)


def payload_items(failures: DataFrame) -> DataFrame:
    """Text of each failure for a model, secrets redacted before anything is cut."""
    safe = lambda c, other: T.redact(F.coalesce(F.col(c), F.lit(other)))
    message, stack = safe("message", "(no message)"), safe("stack", "(no stack)")
    cut = F.when(F.length(message) > MESSAGE_CHARS, F.concat(F.substring(message, 1, MESSAGE_CHARS), F.lit("… (cut)"))).otherwise(message)
    lines = F.concat_ws("\n", F.concat(F.lit("test: "), "test_key"), F.concat(F.lit("status: "), "status"), F.concat(F.lit("fingerprint: "), F.coalesce("fingerprint", F.lit("(none)"))), F.lit("message:"), cut, F.lit("stack:"), T.truncate_lines(stack, STACK_LINES))
    return failures.select(*(c for c in ("run_id",) if c in failures.columns), "id", lines.alias("item"), T.token_estimate(lines).alias("tokens"))


def parse_model_answers(answers: DataFrame) -> DataFrame:
    """Validated verdicts of model answers (position, json): wrong kinds, confidences or missing fields leave ``valid`` false."""
    v = F.from_json("json", MODEL_VERDICT)
    ok = v["test_key"].isNotNull() & v["kind"].isin("flake_likely", "real_regression", "infra_failure", "unknown") & v["confidence"].isin("low", "medium", "high") & (F.length(v["one_line_reason"]) <= 200) & v["likely_cause"].isNotNull() & v["suggested_next_step"].isNotNull()
    return answers.select("position", v["test_key"].alias("test_key"), v["kind"].alias("kind"), v["confidence"].alias("confidence"), F.coalesce(ok, F.lit(False)).alias("valid"))


def focused_diff(diff: Column, paths: Column) -> Column:
    """A unified diff with the parts of the files in ``paths`` (in the diff's order) once more in front of the whole."""
    pieces = F.filter(F.split(diff, "(?m)(?=^diff --git )"), lambda p: p != "")
    known = F.transform(F.coalesce(paths, F.array().cast("array<string>")), lambda p: F.replace(p, F.lit("\\"), F.lit("/")))
    own = F.filter(pieces, lambda p: F.array_contains(known, F.regexp_extract(p, "^diff --git a/.*? b/(.*)", 1)))
    front = F.regexp_replace(F.array_join(own, ""), "\n+\\z", "")
    return F.when(front != "", F.concat(front, F.lit("\n"), diff)).otherwise(diff)


def payloads(runs: DataFrame, items: DataFrame, diffs: DataFrame | None = None, most: int = 15, files: int = PAYLOAD_FILES, diff_lines: int = DIFF_LINES, budget: int | None = None) -> DataFrame:
    """(run_id, payload, tokens, taken, omitted): one text per run for a model, from run context, failures and diff.

    ``items`` are (run_id, id, item, tokens), the first ``most`` of a run by id; with a ``budget`` of tokens only as many
    of those as fit one after another. ``diffs`` are (run_id, diff, paths); files of ``paths`` come first, and what is
    beyond ``diff_lines`` is counted. What is left out is said at the end.
    """
    of = W.partitionBy("run_id").orderBy("id", "item")
    n = items.groupBy("run_id").agg(F.count(F.lit(1)).alias("all"))
    first = items.withColumns({"place": F.row_number().over(of)}).where(F.col("place") <= most)  # a few rows a run from here
    first = first.withColumn("upto", F.sum("tokens").over(of.rowsBetween(W.unboundedPreceding, W.currentRow)))
    kept = first.where(F.col("upto") <= budget) if budget is not None else first
    texts = kept.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("items"))
    met = n.join(texts, "run_id", "left").join(runs.withColumnRenamed("id", "run_id"), "run_id")
    if diffs is not None:
        cut = T.truncate_lines(focused_diff(F.col("diff"), F.col("paths")), diff_lines)
        met = met.join(diffs.select("run_id", cut.alias("diff")), "run_id", "left")
    else:
        met = met.withColumn("diff", F.lit(None).cast("string"))
    changed = F.coalesce("changed_files", F.array().cast("array<string>"))
    listed = F.transform(F.slice(changed, 1, files), lambda f: F.concat(F.lit("  - "), f))
    more = F.when(F.size(changed) > files, F.array(F.format_string("  … %d more files", F.size(changed) - files))).otherwise(F.array().cast("array<string>"))
    taken = F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0))
    left = F.col("all") - taken
    head = F.array(F.lit("# run"), F.concat(F.lit("commit: "), "commit_sha"), F.concat(F.lit("parent: "), F.coalesce("parent_sha", F.lit("(none)"))), F.concat(F.lit("branch: "), F.coalesce("branch", F.lit("(none)"))), F.format_string("attempt: %d", F.col("attempt")), F.format_string("changed files: %d", F.size(changed)))
    body = F.transform(F.coalesce("items", F.array().cast("array<struct<place:int,item:string>>")), lambda x: F.concat(F.lit("\n"), x["item"]))
    tail = F.array_compact(F.array(F.when(F.trim(F.coalesce("diff", F.lit(""))) != "", F.concat(F.lit("\n# diff\n"), "diff")), F.when(left > 0, F.format_string("\n(%d failures are not in this batch)", left))))
    text = F.array_join(F.concat(head, listed, more, F.array(F.format_string("\n# open failures: %d", taken)), body, tail), "\n")
    return met.select("run_id", text.alias("payload"), T.token_estimate(text).cast("long").alias("tokens"), taken.cast("long").alias("taken"), left.cast("long").alias("omitted"))


def run_reports(runs: DataFrame, results: DataFrame, verdicts: DataFrame, most: int = 8) -> DataFrame:
    """(run_id, report): a run as one JSON document: what ran, totals, and its first verdicts of each bucket with how many more there are.

    Verdicts are numbered within a run and bucket; only the first ``most`` go on, so documents stay small.
    """
    s = F.col("status")
    totals = results.groupBy("run_id").agg(F.count_if(s == "passed").alias("passed"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s.isin("failed", "error")).alias("failures"))
    v = verdicts.withColumns({"bucket": C.bucket(F.col("kind")), "k": C.kind_order(F.col("kind")), "c": -C.confidence_rank(F.col("confidence"))})
    counts = v.groupBy("run_id").agg(F.count_if(F.col("kind") == "real_regression").alias("regressions"), *(F.count_if(F.col("bucket") == b).alias(b) for b in C.BUCKETS), F.count_if(F.col("kind").startswith("flake")).alias("flaky"))
    place = F.row_number().over(W.partitionBy("run_id", "bucket").orderBy("k", "c", "id", "test_key"))
    item = F.struct("place", F.col("test_key").alias("test"), "kind", "confidence", F.slice("evidence", 1, 2).alias("evidence"))
    tops = v.withColumn("place", place).where(F.col("place") <= most).groupBy("run_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, item))).alias(f"top_{b}") for b in C.BUCKETS))
    met = meet(meet(meet(runs.withColumnRenamed("id", "run_id"), totals, "run_id"), counts, "run_id", "left"), tops, "run_id", "left")
    some = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    groups = F.struct(*(F.struct(some(b).alias("n"), F.greatest(some(b) - most, F.lit(0)).alias("more"), F.transform(F.coalesce(f"top_{b}", F.array().cast("array<struct<place:int,test:string,kind:string,confidence:string,evidence:array<string>>>")), lambda x: x.dropFields("place")).alias("first")).alias(b) for b in C.BUCKETS))
    body = F.struct(F.lit(2).alias("schema_version"), F.struct("repo", "commit_sha", "parent_sha", "branch", "attempt", "started_at", F.size(F.coalesce("changed_files", F.array().cast("array<string>"))).alias("changed_files")).alias("run"), F.struct("passed", "skipped", "failures", some("regressions").alias("regressions"), some("flaky").alias("flaky")).alias("totals"), groups.alias("buckets"))
    return met.select("run_id", F.to_json(body).alias("report"))
