"""What the history knows about one test: identity, last failure, timeline, spread of its fingerprint, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TestNotFoundError
from ..functions.keys import failing
from . import blame as B
from . import classify as C
from . import history as H
from .facts import facts
from .report import stack_places, start_at


def blamed(runs: DataFrame, results: DataFrame, hunks: DataFrame | None = None, imports: DataFrame | None = None, run_ids: DataFrame | None = None) -> DataFrame:
    """(id, run_id, test_key, blame): what the stacks of failing results have to do with their run's change, for those that have.

    Only stacks that hold the name of a changed file (or of one that imports such a file) are parsed. Without ``hunks``
    the stored changed files stand in: then only same_file and imported_by can apply.
    """
    if hunks is None:
        none = F.array().cast("array<int>")
        hunks = runs.select(F.col("id").alias("change"), F.posexplode("changed_files").alias("ordinal", "file")).select("change", "ordinal", "file", F.lit(2**31 - 100).alias("new_start"), F.lit(0).alias("new_lines"), none.alias("changed_lines"))
    named = hunks.select("change", B.base_name(F.col("file")).alias("name"))
    if imports is not None:
        named = named.unionByName(imports.select("change", B.base_name(F.col("file")).alias("name")))
    names = named.groupBy("change").agg(F.collect_set("name").alias("names"))  # the files of one change
    bad = results.where(failing(F.col("status")) & F.col("stack").isNotNull()).select("id", "run_id", "test_key", "stack")
    if run_ids is not None:
        bad = bad.join(run_ids, "run_id", "left_semi")
    low = F.lower("stack")
    near = H.meet(bad.withColumn("change", F.col("run_id")), names, "change").where(F.exists("names", lambda n: F.contains(low, n)))
    frames = near.select(F.struct("id", "run_id", "test_key").alias("failure"), "change", F.posexplode(B.parse_frames(F.col("stack"))).alias("depth", "f")).select("failure", "change", "depth", "f.file", "f.line")
    return B.top_blame(B.correlate(frames, hunks, imports)).select("failure.*", "blame")


def verdicts(runs: DataFrame, results: DataFrame, window: int = 30, run_ids: DataFrame | None = None, hunks: DataFrame | None = None, imports: DataFrame | None = None, as_of: str = "run", rows: DataFrame | None = None) -> DataFrame:
    """Verdict of every failing result (of ``run_ids``, if given), from the history as it was before its run, or as it is ``now``.

    Failure texts are looked at where they are read; what is shuffled is their label and their links. ``rows`` are the
    facts, where they are known already (from a store's states); then ``results`` need only hold the failures.
    """
    text = F.concat_ws("\n", "message", "stack")
    told = {"infra": F.when(failing(F.col("status")), C.infra_of(text)), "places": F.when(failing(F.col("status")), stack_places(F.col("stack")))}
    if rows is None:
        rows = facts(runs, results, window, run_ids, as_of, told)
    else:
        rows = rows.join(results.where(failing(F.col("status"))).withColumns(told).select("id", "run_id", "test_key", *told), ["id", "run_id", "test_key"])
    links = blamed(runs, results, hunks, imports, run_ids)
    empty = F.array().cast("array<struct<o:double,depth:int,file:string,line:int,changed_file:string,proximity:string,confidence:double>>")
    met = H.meet(rows, links, ["id", "run_id", "test_key"], "left").withColumn("blame", F.coalesce("blame", empty))
    return C.classify(met).withColumn("hint", start_at(F.col("kind"), F.col("blame"), F.col("places"), F.col("changed_files"))).drop("places")


def explain(runs: DataFrame, results: DataFrame, query: str, last: int = 20) -> dict:
    """Collected facts of the first test that ``query`` finds (at most ``last`` timeline rows); others found are listed."""
    found = H.find_tests(results, query).limit(6).collect()
    if not found:
        raise TestNotFoundError(query)
    key = found[0]["test_key"]
    mine = H.of_test(results, key)
    failure = H.latest_failure(runs, mine).first()
    rows = H.timeline(runs, mine).orderBy(F.desc("started_at"), F.desc("run_id")).limit(last).collect()
    spread = H.fingerprint_spread(runs, results.where(F.col("fingerprint") == failure["fingerprint"])).first() if failure and failure["fingerprint"] else None
    flips = H.history_flips(H.timeline(runs, mine), last).first()
    # over the whole history: other tests' rows count in how far the fingerprint has spread
    run = results.sparkSession.createDataFrame([(failure["run_id"],)], "run_id long") if failure else None
    verdict = verdicts(runs, results, run_ids=run, as_of="now").where(F.col("id") == failure["id"]).select("kind", "confidence", "evidence").first() if failure else None
    return {"test": found[0].asDict(), "others": [f.asDict() for f in found[1:]], "latest_failure": failure and failure.asDict(), "timeline": [r.asDict() for r in reversed(rows)], "spread": spread and spread.asDict(), "flips": flips and flips.asDict(), "verdict": verdict and verdict.asDict(recursive=True)}


def explain_text(found: dict, stack_lines: int = 20) -> str:
    """The answer of :func:`explain` laid out as text: identity, verdict, last failure, timeline, spread, other matches."""
    test, failure, verdict = found["test"], found["latest_failure"], found["verdict"]
    out = [f"{test['suite']} › {test['test_name']}", f"key {test['test_key']}, {test['n_runs']} run(s)", ""]
    if verdict:
        out += [f"verdict: {verdict['kind']} ({verdict['confidence']})", *(f"  - {e}" for e in verdict["evidence"]), ""]
    if failure:
        lines = (failure["stack"] or "").splitlines()
        out += [f"last failure: run {failure['run_id']}, {failure['status']}", f"  {failure['message'] or '(no message)'}", *(f"    {x}" for x in lines[:stack_lines])]
        out += [f"    … {len(lines) - stack_lines} more lines"] * (len(lines) > stack_lines) + [""]
    out.append("timeline (oldest first):")
    out += [f"  run {r['run_id']}: {r['status']}" + (f", {r['duration_ms']} ms" if r["duration_ms"] is not None else "") for r in found["timeline"]]
    if found["flips"]:
        out.append(f"flips: {found['flips']['flips']}")
    if found["spread"]:
        s = found["spread"]
        out.append(f"fingerprint {s['fingerprint']}: {s['n']} time(s) on {s['branches']} branch(es), {s['commits']} commit(s), {s['tests']} test(s)")
    if found["others"]:
        out += ["", "also found:", *(f"  {o['suite']} › {o['test_name']}" for o in found["others"])]
    return "\n".join(out)
