"""Registry of the library's queries: name to callable, and name to DuckDB SQL where SQL can express it.

Each query applies an operator to whole tables; the oracles are written independently, over the adapter's common table
expressions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as T
from ..operators import blame as B
from ..operators import classify as C
from ..operators import history as H
from ..operators import explain as E
from ..operators import facts as N
from ..operators import report as P
from ..sources.reports import analyzed, parse_files
from ..streaming.online import failures_by_window
from .adapters import CTE, results, runs, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, history: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (CTE if history else "") + sql
        return f

    return add


def on_history(name: str, sql: str, f):
    """A query of runs and results."""
    query(name, sql)(lambda spark, d: f(runs(spark, d), results(spark, d)))


# --- rollups, timelines, windows -------------------------------------------------------------------------------------

on_history("results_runs_join", "SELECT run_id, test_key, status, commit_sha, branch, attempt FROM joined", lambda u, r: H.joined(u, r).select("run_id", "test_key", "status", "commit_sha", "branch", "attempt"))
on_history("status_rollup", "SELECT test_key, run_id, status FROM rolled", lambda u, r: H.status_rollup(r))
_ROLL = "CASE WHEN bool_or(status = 'failed') OR bool_or(status = 'error') THEN 'fail' WHEN bool_or(status = 'passed') THEN 'pass' END"
on_history("outcome_on_commit", f"SELECT commit_sha, test_key, {_ROLL} AS outcome FROM joined GROUP BY ALL", H.outcome_on_commit)
_TIMELINE = """timeline AS (SELECT x.run_id, x.test_key, x.suite, x.status, x.duration_ms, x.fingerprint, x.message, u.commit_sha, u.branch, u.attempt, u.started_at, u.changed_files FROM
 (SELECT test_key, run_id, max(suite) AS suite, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'passed') THEN 'passed' ELSE 'skipped' END AS status,
 sum(duration_ms)::BIGINT AS duration_ms, max(CASE WHEN status IN ('failed', 'error') THEN fingerprint END) AS fingerprint, max(CASE WHEN status IN ('failed', 'error') THEN message END) AS message FROM results GROUP BY ALL) x JOIN runs u ON u.id = x.run_id)
"""
on_history("timeline", f", {_TIMELINE} SELECT run_id, test_key, status, duration_ms, fingerprint, message, commit_sha, started_at FROM timeline", lambda u, r: H.timeline(u, r).select("run_id", "test_key", "status", "duration_ms", "fingerprint", "message", "commit_sha", "started_at"))
_RECENT = "recent AS (SELECT x.test_key, x.run_id, x.status, m.suite, m.test_name, m.fingerprint, u.started_at FROM rolled x JOIN (SELECT test_key, run_id, max(suite) AS suite, max(test_name) AS test_name, max(fingerprint) AS fingerprint FROM results GROUP BY ALL) m USING (test_key, run_id) JOIN runs u ON u.id = x.run_id WHERE u.id > (SELECT max(id) FROM runs) - {w})"
on_history("rows_for_flakiness", f", {_RECENT.format(w=200)} SELECT * FROM recent", lambda u, r: H.rows_for_flakiness(u, r).select("test_key", "run_id", "status", "suite", "test_name", "fingerprint", "started_at"))
_ALL = 1 << 60
_FLAKY = f""", {_RECENT.format(w=_ALL)},
settled AS (SELECT *, CASE WHEN status = 'passed' THEN 'pass' WHEN status IN ('failed', 'error') THEN 'fail' END AS o FROM recent),
lagged AS (SELECT test_key, o, lag(o) OVER (PARTITION BY test_key ORDER BY started_at, run_id) AS b FROM settled WHERE o IS NOT NULL),
flipped AS (SELECT test_key, count(*) AS n_runs, count(*) FILTER (WHERE o <> b) AS flips, count(*) FILTER (WHERE o = 'pass') AS passes, count(*) FILTER (WHERE o = 'fail') AS failures FROM lagged GROUP BY ALL HAVING count(*) >= 3),
stats AS (SELECT test_key, suite, test_name, n_runs, flips, passes, failures, last_status, fingerprints, CASE WHEN n_runs > 1 THEN flips / (n_runs - 1) ELSE 0.0 END AS flip_rate FROM flipped JOIN
 (SELECT test_key, max(suite) AS suite, max(test_name) AS test_name, arg_max(status, (started_at, run_id)) AS last_status, count(DISTINCT fingerprint) AS fingerprints FROM settled GROUP BY ALL) USING (test_key))
"""


def _stats(u, r):
    return H.flaky_stats(H.rows_for_flakiness(u, r, _ALL))


on_history("flaky_stats", _FLAKY + "SELECT * FROM stats", _stats)
on_history("top_flaky", _FLAKY + "SELECT * FROM stats ORDER BY flip_rate DESC, flips DESC, n_runs DESC, test_key LIMIT 10", lambda u, r: H.top_flaky(_stats(u, r)))
on_history("flip_rate", _FLAKY + "SELECT test_key, flips, flip_rate FROM stats", lambda u, r: _stats(u, r).select("test_key", "flips", "flip_rate"))
_SPREAD = "spread AS (SELECT fingerprint, count(*) AS n, count(DISTINCT branch) AS branches, count(DISTINCT commit_sha) AS commits, count(DISTINCT test_key) AS tests, min(started_at) AS first_seen, max(started_at) AS last_seen, min(message) AS sample_message FROM joined WHERE fingerprint IS NOT NULL GROUP BY ALL)"
on_history("fingerprint_spread", f", {_SPREAD} SELECT * FROM spread", H.fingerprint_spread)
on_history("fingerprint_branches", f", {_SPREAD} SELECT id, greatest(coalesce(branches, 0), 1) AS branches FROM results LEFT JOIN spread USING (fingerprint) WHERE status IN ('failed', 'error')", H.spread_branches)
on_history("history_summary", "SELECT (SELECT count(*) FROM runs) AS runs, (SELECT min(started_at) FROM runs) AS first_run, (SELECT max(started_at) FROM runs) AS last_run, count(*) AS results, count(DISTINCT test_key) AS tests, count(DISTINCT fingerprint) AS fingerprints FROM results", H.history_summary)
on_history("run_count_for_test", "SELECT test_key, count(DISTINCT run_id) AS n_runs FROM results GROUP BY ALL", lambda u, r: H.run_counts(r))
on_history("ever_passed", "SELECT test_key, bool_or(status = 'passed') AS ever_passed FROM results GROUP BY ALL", lambda u, r: H.ever_passed(r))
on_history("run_totals", "SELECT run_id, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status IN ('failed', 'error')) AS failures FROM results GROUP BY ALL", lambda u, r: H.run_totals(r))
on_history("passed_in_another_attempt", "SELECT DISTINCT a.commit_sha, a.test_key, a.attempt FROM joined a WHERE EXISTS (SELECT 1 FROM joined b WHERE b.commit_sha = a.commit_sha AND b.test_key = a.test_key AND b.attempt <> a.attempt AND b.status = 'passed')", H.passed_in_another_attempt)
_ATTEMPTS = "SELECT commit_sha, test_key, list_sort(list(DISTINCT attempt)) AS attempts FROM joined WHERE status IN ('failed', 'error') GROUP BY ALL"
on_history("failed_attempts_on_commit", f"SELECT commit_sha, test_key, array_to_string(attempts, ',') AS attempts FROM ({_ATTEMPTS})", lambda u, r: H.failed_attempts(u, r).withColumn("attempts", F.array_join(F.col("attempts").cast("array<string>"), ",")))
on_history("parent_outcome", f"SELECT DISTINCT j.run_id, j.test_key, p.outcome AS parent_outcome FROM joined j LEFT JOIN (SELECT commit_sha, test_key, {_ROLL} AS outcome FROM joined GROUP BY ALL) p ON p.commit_sha = j.parent_sha AND p.test_key = j.test_key", H.parent_outcome)
on_history("recent_window", f", {_TIMELINE} SELECT test_key, run_id, row_number() OVER (PARTITION BY test_key ORDER BY started_at DESC, run_id DESC) AS back FROM timeline QUALIFY back <= 29", lambda u, r: H.recent_window(H.timeline(u, r)).select("test_key", "run_id", F.col("back").cast("long").alias("back")))
on_history("history_flips", f", {_TIMELINE}, latest AS (SELECT test_key, run_id, started_at, status FROM timeline QUALIFY row_number() OVER (PARTITION BY test_key ORDER BY started_at DESC, run_id DESC) <= 20), lagged AS (SELECT test_key, status = 'passed' AS o, lag(status = 'passed') OVER (PARTITION BY test_key ORDER BY started_at, run_id) AS b FROM latest WHERE status <> 'skipped') SELECT test_key, count(*) AS n, count(*) FILTER (WHERE o <> b) AS flips FROM lagged GROUP BY ALL", lambda u, r: H.history_flips(H.timeline(u, r)))
_TOUCHED = "list_contains(list_transform(changed_files, lambda f: split_part(f, '/', -1)), concat(split_part(suite, '.', -1), '.py'))"
on_history("unexplained_flips", f", {_TIMELINE}, lagged AS (SELECT test_key, status = 'passed' AS o, lag(status = 'passed') OVER (PARTITION BY test_key ORDER BY started_at, run_id) AS b, {_TOUCHED} AS touched FROM timeline) SELECT test_key, count(*) AS considered, count(*) FILTER (WHERE o <> b) AS total, count(*) FILTER (WHERE o <> b AND NOT touched) AS unexplained FROM lagged GROUP BY ALL", lambda u, r: H.flips(H.timeline(u, r), K.strict(F.col("status")), C.test_file_touched(F.col("changed_files"), C.test_file_candidates(F.lit(None).cast("string"), F.col("suite")))))
on_history("latest_failure", "SELECT test_key, run_id, id, status, message, fingerprint, commit_sha FROM joined WHERE status IN ('failed', 'error') QUALIFY row_number() OVER (PARTITION BY test_key ORDER BY started_at DESC, run_id DESC, id DESC) = 1", lambda u, r: H.latest_failure(u, r).select("test_key", "run_id", "id", "status", "message", "fingerprint", "commit_sha"))
on_history("recent_runs", "SELECT id, repo, commit_sha, branch, attempt, started_at FROM runs ORDER BY id DESC LIMIT 20", lambda u, r: H.recent_runs(u).select("id", "repo", "commit_sha", "branch", "attempt", "started_at"))
on_history("flaky_passes", f"SELECT run_id, test_key, array_to_string(attempts, ',') AS attempts FROM (SELECT DISTINCT run_id, test_key, list_filter(f.attempts, lambda a: a <> j.attempt) AS attempts FROM joined j JOIN ({_ATTEMPTS}) f USING (commit_sha, test_key) WHERE status = 'passed') WHERE len(attempts) > 0", lambda u, r: H.flaky_passes(u, r).withColumn("attempts", F.array_join(F.col("attempts").cast("array<string>"), ",")))
on_history("find_tests", "SELECT test_key, max(suite) AS suite, max(test_name) AS test_name, count(DISTINCT run_id) AS n_runs FROM results WHERE test_name = 'PART1_' OR suite || '::' || test_name ILIKE '%PART1_%' OR test_key ILIKE 'PART1_%' GROUP BY ALL", lambda u, r: H.find_tests(r, "PART1_"))

_TUPLE = "repo, commit_sha, ci_run_id, attempt"
#: Every run as it is, and once more as the next attempt of the same build.
_OFFERED = f"SELECT id, {_TUPLE} FROM runs UNION ALL SELECT id + 1000000000, repo, commit_sha, ci_run_id, attempt + 1 FROM runs"


def offered(u):
    own = u.select("id", "repo", "commit_sha", "ci_run_id", "attempt")
    return own.unionByName(own.withColumns({"id": F.col("id") + 1_000_000_000, "attempt": F.col("attempt") + 1}))


on_history("run_exists", f"SELECT c.id FROM ({_OFFERED}) c WHERE EXISTS (SELECT 1 FROM runs u WHERE u.repo = c.repo AND u.commit_sha = c.commit_sha AND u.ci_run_id IS NOT DISTINCT FROM c.ci_run_id AND u.attempt = c.attempt)", lambda u, r: H.run_exists(offered(u), u).select("id"))
on_history("record_run_dedup", f"SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY {_TUPLE} ORDER BY id) AS k FROM ({_OFFERED})) c WHERE (ci_run_id IS NULL OR k = 1) AND NOT EXISTS (SELECT 1 FROM runs u WHERE u.repo = c.repo AND u.commit_sha = c.commit_sha AND u.ci_run_id = c.ci_run_id AND u.attempt = c.attempt)", lambda u, r: H.new_runs(offered(u), u).select("id"))

# --- verdicts --------------------------------------------------------------------------------------------------------

_HEAD = f""", {_TIMELINE},
lagged AS (SELECT *, lag(status = 'passed') OVER past AS was, count(*) OVER before AS prior_runs, coalesce(bool_or(status = 'passed') OVER before, false) AS ever_passed, count(*) OVER (past ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS considered,
 {_TOUCHED} AS touched FROM timeline WINDOW past AS (PARTITION BY test_key ORDER BY started_at, run_id), before AS (PARTITION BY test_key ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flipped AS (SELECT *, (sum(((status = 'passed') <> was)::INT) OVER inside)::BIGINT AS flips, (sum(((status = 'passed') <> was AND NOT touched)::INT) OVER inside)::BIGINT AS unexplained FROM lagged WINDOW inside AS (PARTITION BY test_key ORDER BY started_at, run_id ROWS BETWEEN 28 PRECEDING AND CURRENT ROW)),
failing AS (SELECT *, row_number() OVER () AS rowno FROM joined WHERE status IN ('failed', 'error')),
"""
_TAIL = """facts AS (SELECT j.id, j.run_id, j.test_key, j.commit_sha, j.parent_sha, j.attempt, j.message, j.fingerprint, f.prior_runs, f.ever_passed, f.considered, coalesce(f.flips, 0) AS flips, coalesce(f.unexplained, 0) AS unexplained,
 coalesce(e.passes, 0) > 0 AS passed_elsewhere, q.parent_outcome, greatest(coalesce(s.branches, 0), 1) AS branches, j.changed_files, j.stack
 FROM failing j JOIN flipped f USING (run_id, test_key) LEFT JOIN elsewhere e USING (rowno) LEFT JOIN parents q USING (rowno) LEFT JOIN spreads s USING (rowno)),
blamed AS (SELECT *, list_contains(changed_files, regexp_extract(stack, 'src/part[0-9]+\\.py')) AS linked, regexp_extract(stack, 'src/part[0-9]+\\.py:([0-9]+)', 1)::INT BETWEEN run_id % 30 - 5 AND run_id % 30 + 8 AS near FROM facts),
verdicts AS (SELECT *, CASE WHEN passed_elsewhere THEN 'flake_confirmed' WHEN regexp_matches(message, 'ECONNREFUSED|503 with status') THEN 'infra_failure' WHEN prior_runs >= 1 AND NOT ever_passed THEN 'always_failing' WHEN unexplained >= 2 OR branches >= 3 THEN 'flake_likely' WHEN parent_outcome = 'pass' AND linked THEN 'real_regression' ELSE 'ambiguous' END AS kind FROM blamed),
judged AS (SELECT *, CASE kind WHEN 'flake_confirmed' THEN 'high' WHEN 'infra_failure' THEN 'high' WHEN 'always_failing' THEN 'high' WHEN 'flake_likely' THEN 'medium' WHEN 'real_regression' THEN CASE WHEN near THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence, CASE kind WHEN 'real_regression' THEN 'needs_you' WHEN 'always_failing' THEN 'look_soon' WHEN 'ambiguous' THEN 'look_soon' ELSE 'safe_to_ignore' END AS bucket,
 list_position(['real_regression', 'always_failing', 'ambiguous', 'infra_failure', 'flake_confirmed', 'flake_likely'], kind) AS k, CASE kind WHEN 'flake_likely' THEN 1 WHEN 'real_regression' THEN CASE WHEN near THEN 2 ELSE 1 END WHEN 'ambiguous' THEN 0 ELSE 2 END AS c FROM verdicts)
"""
_STATUS = "CASE WHEN bool_or(p.status IN ('failed', 'error')) THEN 'fail' WHEN bool_or(p.status = 'passed') THEN 'pass' END"


def _lookups(before: str) -> str:
    """What each failing row finds in the history; ``before`` says which rows p of it count."""
    return f"""elsewhere AS (SELECT j.rowno, count(*) AS passes FROM failing j JOIN joined p ON p.commit_sha = j.commit_sha AND p.test_key = j.test_key AND p.attempt <> j.attempt AND p.status = 'passed' AND {before} GROUP BY ALL),
parents AS (SELECT j.rowno, {_STATUS} AS parent_outcome FROM failing j JOIN joined p ON p.commit_sha = j.parent_sha AND p.test_key = j.test_key AND {before} GROUP BY ALL),
spreads AS (SELECT j.rowno, count(DISTINCT p.branch) AS branches FROM failing j JOIN failing p ON p.fingerprint = j.fingerprint AND {before} GROUP BY ALL),
"""


#: Facts from what had started before the failure's run, and from the whole history.
_FACTS = _HEAD + _lookups("(p.started_at < j.started_at OR p.started_at = j.started_at AND p.run_id < j.run_id)") + _TAIL
_FACTS_NOW = _HEAD + _lookups("true") + _TAIL
_FACT_COLUMNS = ("id", "prior_runs", "ever_passed", "considered", "flips", "unexplained", "passed_elsewhere", "parent_outcome", "branches")


def verdict_rows(u, r, as_of="run"):
    """Verdicts of all failing results; the changed files of a run, with three lines each at a place by its id, stand in for its diff."""
    return E.verdicts(u, r, hunks=_hunks(u), as_of=as_of)


on_history("classifier_facts", _FACTS + f"SELECT {', '.join(_FACT_COLUMNS)} FROM facts", lambda u, r: N.facts(u, r).select(*_FACT_COLUMNS))
on_history("classifier_facts_now", _FACTS_NOW + f"SELECT {', '.join(_FACT_COLUMNS)} FROM facts", lambda u, r: N.facts(u, r, as_of="now").select(*_FACT_COLUMNS))
on_history("classify", _FACTS + "SELECT id, kind, confidence FROM judged", lambda u, r: verdict_rows(u, r).select("id", "kind", "confidence"))
on_history("classify_now", _FACTS_NOW + "SELECT id, kind, confidence FROM judged", lambda u, r: verdict_rows(u, r, "now").select("id", "kind", "confidence"))
on_history("action_bucket", _FACTS + "SELECT id, bucket FROM judged", lambda u, r: verdict_rows(u, r).select("id", C.bucket(F.col("kind")).alias("bucket")))
on_history("headline", _FACTS + "SELECT *, CASE WHEN needs_you > 0 THEN 'red' WHEN look_soon > 0 THEN 'orange' ELSE 'green' END AS light FROM (SELECT count(*) FILTER (WHERE kind = 'real_regression') AS regressions, count(*) FILTER (WHERE bucket = 'needs_you') AS needs_you, count(*) FILTER (WHERE bucket = 'look_soon') AS look_soon, count(*) FILTER (WHERE kind LIKE 'flake%') AS flaky, count(*) FILTER (WHERE kind = 'ambiguous') AS ambiguous FROM judged)", lambda u, r: C.headline(verdict_rows(u, r)))
on_history("bucket_summary", _FACTS + "SELECT bucket, kind, count(*) AS n FROM judged GROUP BY ALL", lambda u, r: C.bucket_summary(verdict_rows(u, r)))
on_history("exit_code", _FACTS + "SELECT CASE WHEN count(*) FILTER (WHERE kind = 'real_regression') > 0 THEN 1 ELSE 0 END AS exit_code FROM judged", lambda u, r: C.exit_code(verdict_rows(u, r)))
on_history("group_by_action", _FACTS + "SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY k, c DESC, id) AS place FROM judged", lambda u, r: C.group_by_action(verdict_rows(u, r).select("id", "kind", "confidence")).select("id", "bucket", F.col("place").cast("long").alias("place")))
on_history("group_top8", _FACTS + "SELECT id, bucket, greatest(count(*) OVER (PARTITION BY bucket) - 8, 0) AS more FROM judged QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY k, c DESC, id) <= 8", lambda u, r: C.top_of_groups(verdict_rows(u, r).select("id", "kind", "confidence")).select("id", "bucket", "more"))
on_history("escalation_batch", _FACTS + "SELECT id, test_key FROM judged WHERE kind = 'ambiguous' ORDER BY id, test_key LIMIT 15", lambda u, r: C.escalation_batch(verdict_rows(u, r)).select("id", "test_key"))
_BATCH = "(SELECT sum(r.duration_ms) FROM results r WHERE (r.id, r.test_key) IN (SELECT (id, test_key) FROM judged WHERE kind = 'ambiguous' ORDER BY id, test_key LIMIT 15))"
_PLAN = "SELECT id, test_key, CASE WHEN p > 15 THEN 'deferred' WHEN {batch} > {most} THEN 'too_large' ELSE 'sent' END AS state FROM (SELECT id, test_key, row_number() OVER (ORDER BY id, test_key) AS p FROM judged WHERE kind = 'ambiguous')"


def _planned(guardrail):
    return lambda u, r: C.escalation_plan(verdict_rows(u, r), r.select("id", "test_key", F.col("duration_ms").alias("tokens")), guardrail=guardrail)


on_history("escalation_plan", _FACTS + _PLAN.format(batch=_BATCH, most=100_000), _planned(100_000))
on_history("escalation_too_large", _FACTS + _PLAN.format(batch=_BATCH, most=10_000), _planned(10_000))


def _retried(r):
    """Results with up to two failed tries each, by id."""
    t = lambda k: F.struct(F.concat(F.lit(f" \n retry {k} of "), "test_name", F.lit("\nmore")).alias("message"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("stack"))
    return r.withColumn("retries", F.slice(F.array(t(1), t(2)), F.lit(1), (F.col("id") % 3).cast("int")))


_PASSED = """, passed AS (SELECT run_id, test_key, commit_sha, attempt, min(id) AS id, (sum(id % 3))::BIGINT AS n, max(test_name) AS test_name FROM joined WHERE status = 'passed' GROUP BY ALL),
 others AS (SELECT p.run_id, p.test_key, list_sort(list(DISTINCT j.attempt)) AS a FROM passed p JOIN joined j ON j.commit_sha = p.commit_sha AND j.test_key = p.test_key AND j.attempt <> p.attempt WHERE j.status IN ('failed', 'error') GROUP BY ALL)
"""
on_history("merged_passes", _PASSED + "SELECT id, run_id, test_key, n FROM passed", lambda u, r: C.merged_passes(_retried(r)).select("id", "run_id", "test_key", F.size("retries").cast("long").alias("n")))
on_history("classify_passed", _PASSED + "SELECT p.id, 'flake_confirmed' AS kind, concat_ws(' | ', CASE WHEN n > 0 THEN concat('failed ', n, ' time(s), then passed in attempt ', attempt, ': retry 1 of ', test_name) END, CASE WHEN a IS NOT NULL THEN concat('failed in attempts ', array_to_string(a, ', '), ' of commit ', left(commit_sha, 7), ', passed in attempt ', attempt) END) AS evidence FROM passed p LEFT JOIN others o ON o.run_id = p.run_id AND o.test_key = p.test_key WHERE n > 0 OR a IS NOT NULL", lambda u, r: C.passed_verdicts(u, _retried(r)).select("id", "kind", F.array_join("evidence", " | ").alias("evidence")))
_ANSWERS = "answers AS (SELECT test_key, arg_max(kind, position) AS mk, arg_max(sure, position) AS ms FROM (SELECT DISTINCT test_key, p AS position, ['flake_likely', 'real_regression', 'unknown'][((ascii(test_key) + p) % 3 + 1)::INT] AS kind, ['high', 'low'][(ascii(test_key) % 2 + 1)::INT] AS sure FROM results, (SELECT unnest([0, 1]) AS p)) GROUP BY ALL)"


def _answers(r):
    t = r.select("test_key").distinct().withColumn("position", F.explode(F.array(F.lit(0), F.lit(1))))
    a = F.ascii("test_key")
    return t.select("test_key", "position", F.get(F.array(*map(F.lit, ("flake_likely", "real_regression", "unknown"))), ((a + F.col("position")) % 3).cast("int")).alias("kind"), F.get(F.array(F.lit("high"), F.lit("low")), (a % 2).cast("int")).alias("confidence"))


_ESCALATED = _FACTS + f", {_ANSWERS}, escalated AS (SELECT id, CASE WHEN j.kind = 'ambiguous' THEN CASE WHEN mk = 'unknown' THEN 'ambiguous' ELSE mk END ELSE j.kind END AS kind, CASE WHEN j.kind = 'ambiguous' THEN CASE WHEN mk = 'unknown' THEN 'low' WHEN mk = 'real_regression' AND ms <> 'high' THEN 'medium' ELSE ms END ELSE confidence END AS confidence, CASE WHEN j.kind = 'ambiguous' THEN 'model' ELSE 'history' END AS source FROM judged j LEFT JOIN answers USING (test_key))"
on_history("apply_escalation", _ESCALATED + "SELECT * FROM escalated", lambda u, r: C.apply_escalation(verdict_rows(u, r), _answers(r)).select("id", "kind", "confidence", "source"))
on_history("accounting", _ESCALATED + "SELECT count(*) FILTER (WHERE source <> 'model') AS from_history, count(*) FILTER (WHERE source = 'model') AS from_model, 0.05::DOUBLE AS usd FROM escalated", lambda u, r: C.accounting(C.apply_escalation(verdict_rows(u, r), _answers(r)), usd=0.05))
on_history("model_to_verdict", f", {_ANSWERS} SELECT test_key, CASE WHEN mk = 'unknown' THEN 'ambiguous' ELSE mk END AS kind, CASE WHEN mk = 'unknown' THEN 'low' WHEN mk = 'real_regression' AND ms <> 'high' THEN 'medium' ELSE ms END AS confidence FROM answers", lambda u, r: _answers(r).where("position = 1").select("test_key", *(c.alias(n) for c, n in zip(C.model_verdict(F.col("kind"), F.col("confidence")), ("kind", "confidence")))))
on_history("cost_estimate", _FLAKY + ", n AS (SELECT suite, count(*) FILTER (WHERE flips >= 2) AS failures FROM stats GROUP BY ALL) SELECT suite, failures, ceil(failures / 15)::BIGINT AS batches, round(ceil(failures / 15) * CASE suite WHEN 'tests.suite1' THEN 0.010 WHEN 'tests.suite2' THEN 0.020 ELSE 0.050 END, 6) AS usd FROM n", lambda u, r: _stats(u, r).groupBy("suite").agg(F.count_if(F.col("flips") >= 2).alias("failures")).withColumn("e", C.cost_estimate(F.col("failures"), F.when(F.col("suite") == "tests.suite1", "small").when(F.col("suite") == "tests.suite2", "medium").otherwise("large"), F.lit(False))).select("suite", "failures", F.col("e.batches").alias("batches"), F.round("e.usd", 6).alias("usd")))
on_history("call_cost", "SELECT id, round((duration_ms * 5.0 + (id % 100) * 0.5 + (id % 10) * 6.25 + (id % 7) * 25.0) / 1e6, 9) AS usd FROM results", lambda u, r: r.select("id", F.round(C.call_cost(F.col("duration_ms"), F.col("id") % 100, F.col("id") % 10, F.col("id") % 7, 5.0, 25.0), 9).alias("usd")))

# --- blame -----------------------------------------------------------------------------------------------------------


def _frames(r):
    bad = r.where(K.failing(F.col("status"))).select(F.col("id").alias("failure"), F.col("run_id").alias("change"), F.posexplode(B.parse_frames(F.col("stack"))).alias("depth", "f"))
    return bad.select("failure", "change", "depth", "f.file", "f.line").distinct()


def _hunks(u):
    return u.select(F.col("id").alias("change"), F.posexplode("changed_files").alias("ordinal", "file")).withColumns({"new_start": (F.col("change") % 30).cast("int"), "new_lines": F.lit(3), "changed_lines": F.array((F.col("change") % 30).cast("int"), (F.col("change") % 30 + 2).cast("int"))})


_FRAMES = "frames AS (SELECT DISTINCT id AS failure, run_id AS change, 0 AS depth, regexp_extract(stack, 'src/part[0-9]+\\.py') AS file, regexp_extract(stack, 'src/part[0-9]+\\.py:([0-9]+)', 1)::INT AS line FROM results WHERE status IN ('failed', 'error') UNION ALL SELECT DISTINCT id, run_id, 1, regexp_extract(stack, 'lib/helper[0-9]+\\.py'), 12 FROM results WHERE status IN ('failed', 'error'))"
_LINKS = f", {_FRAMES}, links AS (SELECT failure, depth, file, line, file AS changed_file, CASE WHEN line IN (h % 30, h % 30 + 2) THEN 'exact_line' WHEN line BETWEEN h % 30 - 5 AND h % 30 + 8 THEN 'same_hunk' ELSE 'same_file' END AS proximity FROM (SELECT f.*, u.id AS h FROM frames f JOIN runs u ON u.id = f.change WHERE list_contains(u.changed_files, f.file)))"
_SURE = "CASE proximity WHEN 'exact_line' THEN 0.95 WHEN 'same_hunk' THEN 0.8 ELSE 0.5 END::DOUBLE"
on_history("parse_stack_frames", f", {_FRAMES} SELECT failure, depth, file, line FROM frames", lambda u, r: _frames(r).select("failure", "depth", "file", "line"))
on_history("blame_proximity", f"{_LINKS} SELECT failure, depth, file, line, changed_file, proximity, {_SURE} AS confidence FROM links", lambda u, r: B.correlate(_frames(r), _hunks(u)))


def _imports(u):
    return u.select(F.col("id").alias("change"), F.explode(F.array(*(F.lit(f"lib/helper{i}.py") for i in range(5)))).alias("file")).withColumn("imported", F.get(B.resolve_import(F.concat(F.lit("../src/part"), (F.col("change") % 40).cast("string"), F.lit(".py")), F.lit("lib")), F.lit(0)))


on_history("blame_correlate", f"{_LINKS} SELECT failure, depth, proximity, {_SURE} AS confidence FROM links UNION ALL SELECT failure, depth, 'imported_by', 0.3 FROM frames f JOIN runs u ON u.id = f.change WHERE depth = 1", lambda u, r: B.correlate(_frames(r), _hunks(u), _imports(u)).select("failure", "depth", "proximity", "confidence"))
on_history("top_blame", f"{_LINKS} SELECT failure, string_agg(proximity, ',' ORDER BY {_SURE} DESC, depth) AS proximities FROM links GROUP BY ALL", lambda u, r: B.top_blame(B.correlate(_frames(r), _hunks(u))).select("failure", F.array_join(F.transform("blame", lambda b: b["proximity"]), ",").alias("proximities")))
on_history("same_path", "SELECT u.id, changed_files[1] = concat('src/part', (u.id % 7)::VARCHAR, '.py') AS same FROM runs u", lambda u, r: u.select("id", B.same_path(F.element_at("changed_files", 1), F.concat(F.lit(".\\SRC\\Part"), (F.col("id") % 7).cast("string"), F.lit(".py"))).alias("same")))
on_history("test_file_candidates", "SELECT DISTINCT suite, concat(split_part(suite, '.', 2), '.java,', split_part(suite, '.', 2), '.kt,', replace(suite, '.', '/'), '.py,', split_part(suite, '.', 2), '.py') AS candidates FROM results", lambda u, r: r.select("suite").distinct().select("suite", F.array_join(C.test_file_candidates(F.lit(None).cast("string"), F.col("suite")), ",").alias("candidates")))
on_history("test_file_touched", f"SELECT run_id, test_key, bool_or({_TOUCHED}) AS touched FROM joined GROUP BY ALL", lambda u, r: H.joined(u, r).groupBy("run_id", "test_key").agg(F.bool_or(C.test_file_touched(F.col("changed_files"), C.test_file_candidates(F.lit(None).cast("string"), F.col("suite")))).alias("touched")))
on_history("distinct_changed_files", "SELECT id, array_to_string(changed_files, '|') AS files FROM runs", lambda u, r: u.select("id", F.array_join(K.distinct_files(F.concat("changed_files", F.reverse("changed_files"))), "|").alias("files")))
_PART, _HELP = "regexp_extract(stack, 'src/part[0-9]+\\.py:[0-9]+')", "regexp_extract(stack, 'lib/helper[0-9]+\\.py:12')"


def _link():
    return F.array(F.struct(F.concat(F.lit("src/at"), (F.col("run_id") % 7).cast("string"), F.lit(".py")).alias("file"), (F.col("run_id") % 100).alias("line")))


on_history("start_hint", f"SELECT id, CASE WHEN status = 'error' THEN NULL WHEN run_id % 3 = 0 THEN concat('src/at', run_id % 7, '.py:', run_id % 100) WHEN {_HELP} = concat('lib/helper', run_id % 5, '.py:12') THEN {_HELP} ELSE {_PART} END AS hint FROM results WHERE status IN ('failed', 'error')", lambda u, r: r.where(K.failing(F.col("status"))).select("id", P.start_hint(F.when(F.col("status") == "failed", "real_regression").otherwise("ambiguous"), F.when(F.col("run_id") % 3 == 0, _link()), F.col("stack"), F.array(F.concat(F.lit("LIB\\Helper"), (F.col("run_id") % 5).cast("string"), F.lit(".py")))).alias("hint")))
on_history("changed_files_codec", "SELECT id, array_to_string(changed_files, '|') AS files FROM runs", lambda u, r: u.select("id", F.array_join(K.split_files(F.concat(F.lit(" \n"), K.join_files(F.col("changed_files")), F.lit(" \n\n"))), "|").alias("files")))

# --- keys and text ---------------------------------------------------------------------------------------------------

on_history("test_key", "SELECT DISTINCT suite, test_name, test_key FROM results", lambda u, r: r.select("suite", "test_name", K.test_key(F.col("suite"), F.col("test_name")).alias("test_key")).distinct())
query("stable_suite", "SELECT p_partkey, regexp_replace(regexp_replace(trim(replace(concat(' ./', p_name, '\\', p_name, '//x '), '\\', '/')), '/+', '/', 'g'), '^\\./', '') AS suite FROM part", False)(lambda s, d: table(s, d, "part").select("p_partkey", K.stable_suite(F.concat(F.lit(" ./"), "p_name", F.lit("\\"), "p_name", F.lit("//x "))).alias("suite")))
on_history("analyze_results", "SELECT id, CASE WHEN status IN ('failed', 'error') AND message IS NOT NULL THEN left(sha256(message || '|'), 16) END AS fingerprint FROM results", lambda u, r: r.select("id", F.when(K.failing(F.col("status")) & F.col("message").isNotNull(), K.fingerprint(F.concat("message", F.lit("|")))).alias("fingerprint")))
on_history("short_forms", "SELECT id, left(commit_sha, 7) AS sha, strftime(make_timestamp(started_at * 1000), '%Y-%m-%d') AS day FROM runs", lambda u, r: u.select("id", K.short_sha(F.col("commit_sha")).alias("sha"), F.date_format(F.timestamp_millis("started_at"), "yyyy-MM-dd").alias("day")))
on_history("time_to_ms", "SELECT id, floor(duration_ms / 1000 * 1000 + 0.5)::BIGINT AS ms FROM results", lambda u, r: r.select("id", K.time_to_ms(F.concat(F.lit(" "), (F.col("duration_ms") / 1000).cast("string"))).alias("ms")))
query("status_precedence", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'error' WHEN l_linestatus = 'F' THEN 'failed' WHEN l_returnflag = 'N' THEN 'skipped' ELSE 'passed' END AS status FROM lineitem", False)(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", K.status_of(F.col("l_returnflag") == "A", F.col("l_linestatus") == "F", F.col("l_returnflag") == "N").alias("status")))
_PW = "(CASE l_returnflag WHEN 'A' THEN 'expected' WHEN 'R' THEN 'unexpected' ELSE 'skipped' END)"
query("pw_status", f"SELECT l_orderkey, l_linenumber, CASE {_PW} WHEN 'skipped' THEN 'skipped' WHEN 'expected' THEN 'passed' ELSE CASE WHEN l_linestatus = 'F' THEN 'error' ELSE 'failed' END END AS status FROM lineitem", False)(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", K.browser_status(F.expr(_PW), F.when(F.col("l_linestatus") == "F", "timedOut").otherwise("failed")).alias("status")))
on_history("glob_match", "SELECT id, regexp_full_match(changed_files[2], '([^/]+/)*suite[0-9]\\.py') AS hit FROM runs", lambda u, r: u.select("id", F.element_at("changed_files", 2).rlike(K.glob_to_regex("**/suite?.py")).alias("hit")))
query("artifact_glob", "SELECT p_partkey, p_name ILIKE '%a%e%' AS hit FROM part", False)(lambda s, d: table(s, d, "part").select("p_partkey", F.col("p_name").rlike(K.artifact_regex("*A*e*")).alias("hit")))
query("repo_slug", "SELECT page_id, concat('org', page_id % 9, '/repo', page_id % 5) AS slug FROM pages", False)(lambda s, d: table(s, d, "pages").select("page_id", K.repo_slug(F.concat(F.when(F.col("page_id") % 2 == 0, "git@host.example:org").otherwise("https://host.example/org"), (F.col("page_id") % 9).cast("string"), F.lit("/repo"), (F.col("page_id") % 5).cast("string"), F.when(F.col("page_id") % 3 == 0, ".git").otherwise(""))).alias("slug")))

_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z', '<TIME>', 'g'), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '<UUID>', 'g'), '/tmp/[^ ]*', '<TMP>', 'g'), '\b0x[0-9a-f]{4,}\b', '<HEX>', 'g'), '127\.0\.0\.1:[0-9]{2,5}\b', '127.0.0.1:<PORT>', 'g'), '\b[0-9]+ms\b', '<DUR>', 'g'), '\b[0-9]+ seconds\b', '<DUR>', 'g')"""
on_history("normalize_message", f"SELECT id, {_NORMAL} AS text FROM results WHERE message IS NOT NULL", lambda u, r: r.where("message is not null").select("id", T.normalize_message(F.col("message")).alias("text")))
_FRAME_TEXT = r"concat('at check (', regexp_extract(stack, 'src/part[0-9]+\.py'), ')', chr(10), 'at main (', regexp_extract(stack, 'lib/helper[0-9]+\.py'), ')')"
on_history("extract_frames", f"SELECT id, {_FRAME_TEXT} AS frames FROM results WHERE stack IS NOT NULL", lambda u, r: r.where("stack is not null").select("id", F.array_join(T.extract_frames(F.col("stack")), "\n").alias("frames")))
on_history("normalize_frame", r"SELECT id, concat('at check (', regexp_extract(stack, 'src/part[0-9]+\.py'), ')') AS frame FROM results WHERE stack IS NOT NULL", lambda u, r: r.where("stack is not null").select("id", T.normalize_frame(F.get(F.split("stack", "\n"), F.lit(1))).alias("frame")))
on_history("normalize_failure", f"SELECT id, concat({_NORMAL}, '|', {_FRAME_TEXT}) AS canonical FROM results WHERE message IS NOT NULL", lambda u, r: r.where("message is not null").select("id", T.normalize_failure(F.col("message"), F.col("stack"))["canonical"].alias("canonical")))
on_history("fingerprint", f"SELECT id, left(sha256(concat({_NORMAL}, '|', {_FRAME_TEXT})), 16) AS fingerprint FROM results WHERE message IS NOT NULL", lambda u, r: r.where("message is not null").select("id", K.fingerprint(T.normalize_failure(F.col("message"), F.col("stack"))["canonical"]).alias("fingerprint")))
_STRONG_SQL = r"(?i)\b(?:[a-z]\w*(?:error|exception)|assert|timeout|timed out|not found|failed)\b|\bexpected \w"
on_history("first_error_line", f"SELECT id, CASE WHEN regexp_matches(message, '{_STRONG_SQL}') THEN message ELSE 'Error: it broke' END AS line FROM results WHERE stack IS NOT NULL", lambda u, r: r.where("stack is not null").select("id", T.first_error_line(F.concat_ws("\n", F.lit("> echo"), "stack", F.lit("12 | x"), "message")).alias("line")))
query("looks_like_frame", r"SELECT doc_id, count(*) FILTER (WHERE regexp_matches(l, '^\s*at\s+\S')) AS frames FROM (SELECT doc_id, unnest(string_split(concat('at ', text), chr(10))) AS l FROM documents) GROUP BY ALL", False)(lambda s, d: table(s, d, "documents").select("doc_id", F.size(F.filter(F.split(F.concat(F.lit("at "), "text"), "\n"), T.looks_like_frame)).cast("long").alias("frames")))
on_history("weak_message", "SELECT id, run_id % 2 = 0 AS weak FROM results", lambda u, r: r.select("id", T.is_weak(F.concat(F.when(F.col("run_id") % 2 == 0, "spec/a.ts:29:3 ").otherwise("a.ts: 29 "), F.col("test_name"))).alias("weak")))
query("dedupe_consecutive", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NULL OR b <> role GROUP BY ALL", False)(lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t")).select("conv_id", F.array_join(T.without_repeats(F.transform("t", lambda x: x["role"])), ",").alias("roles")))
query("redact_text", r"SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(text, 'bearer\s+[a-z0-9._=-]+', '[REDACTED]', 'gi'), '(api[_-]?key|passwd|password|pwd|secret|token)\s*[=:]\s*\S+', '[REDACTED]', 'gi'), '\bAKIA[A-Z0-9]{16}\b', '[REDACTED]', 'g'))::INT AS n FROM documents", False)(lambda s, d: table(s, d, "documents").select("doc_id", F.length(T.redact(F.col("text"))).alias("n")))
query("escape_html", "SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS h FROM pages", False)(lambda s, d: table(s, d, "pages").select("page_id", F.sha2(T.escape_html(F.col("html")), 256).alias("h")))
query("decode_entities", "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')) AS h FROM pages", False)(lambda s, d: table(s, d, "pages").select("page_id", F.sha2(T.decode_named(F.col("html")), 256).alias("h")))
query("token_estimate", "SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens FROM documents", False)(lambda s, d: table(s, d, "documents").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens")))
query("truncate_lines", "SELECT doc_id, sha256(CASE WHEN len(ls) > 3 THEN concat(array_to_string(ls[1:3], chr(10)), chr(10), '… ', (len(ls) - 3)::VARCHAR, CASE WHEN len(ls) = 4 THEN ' more line' ELSE ' more lines' END) ELSE text END) AS h FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)", False)(lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(T.truncate_lines(F.col("text"), 3), 256).alias("h")))
on_history("referenced_files", r"SELECT id, concat(regexp_extract(stack, 'src/part[0-9]+\.py'), '|node_modules/runner/index.js|', regexp_extract(stack, 'lib/helper[0-9]+\.py')) AS files FROM results WHERE stack IS NOT NULL", lambda u, r: r.where("stack is not null").select("id", F.array_join(T.referenced_files(F.col("stack")), "|").alias("files")))
on_history("parse_imports", "SELECT id, concat('./', test_name, '|', suite, '|os') AS specs FROM results", lambda u, r: r.select("id", F.array_join(T.parse_imports(F.concat(F.lit("import x from './"), "test_name", F.lit("';\nfrom "), "suite", F.lit(" import y\nimport os\n"))), "|").alias("specs")))

# --- reports, payloads, streams --------------------------------------------------------------------------------------


def _json(u, r):
    v = verdict_rows(u, r)
    j = P.json_lines(v)
    return j.select("id", F.get_json_object("json", "$.kind").alias("kind"), F.get_json_object("json", "$.bucket").alias("bucket"), F.get_json_object("json", "$.schema_version").cast("int").alias("version"))


on_history("json_report", _FACTS + "SELECT id, kind, bucket, 2::INT AS version FROM judged", _json)


def _payload(u, r):
    return P.payload_items(r.where(K.failing(F.col("status")))).select("id", F.sha2("item", 256).alias("h"), F.col("tokens").cast("long").alias("tokens"))


_ITEM = r"concat('test: ', test_key, chr(10), 'status: ', status, chr(10), 'fingerprint: ', fingerprint, chr(10), 'message:', chr(10), regexp_replace(message, 'password=\S+', '[REDACTED]'), chr(10), 'stack:', chr(10), stack)"
on_history("build_payload", f"SELECT id, sha256({_ITEM}) AS h, ceil(length({_ITEM}) / 4)::BIGINT AS tokens FROM results WHERE status IN ('failed', 'error')", _payload)


_CHANGED = "concat('diff --git a/', f, ' b/', f, chr(10), '@@ -1 +1,2 @@', chr(10), '+a', chr(10), '+b', chr(10))"
_RUN_PAYLOAD = rf"""items AS (SELECT run_id, id, {_ITEM} AS item FROM results WHERE status IN ('failed', 'error')),
placed AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id, item) AS p, count(*) OVER (PARTITION BY run_id) AS n FROM items),
taken AS (SELECT run_id, max(n) AS n, count(*) FILTER (WHERE p <= 2) AS taken, string_agg(item, chr(10) || chr(10) ORDER BY p) FILTER (WHERE p <= 2) AS texts FROM placed GROUP BY ALL),
paths AS (SELECT run_id, list(DISTINCT regexp_extract(stack, 'src/part[0-9]+\.py')) AS paths FROM results WHERE status IN ('failed', 'error') GROUP BY ALL),
diffs AS (SELECT u.id AS run_id, string_split(concat(array_to_string(list_transform(list_filter(changed_files, lambda f: list_contains(paths, f)), lambda f: {_CHANGED}), ''), array_to_string(list_transform(changed_files, lambda f: {_CHANGED}), '')), chr(10)) AS ls FROM runs u JOIN paths ON run_id = u.id),
texts AS (SELECT t.run_id, n, taken, concat('# run', chr(10), 'commit: ', commit_sha, chr(10), 'parent: ', parent_sha, chr(10), 'branch: ', branch, chr(10), 'attempt: ', attempt, chr(10), 'changed files: 7', chr(10), '  - ', changed_files[1], chr(10), '  - ', changed_files[2], chr(10), '  - ', changed_files[3], chr(10), '  … 4 more files', chr(10), chr(10),
 '# open failures: ', taken, chr(10), chr(10), texts, chr(10), chr(10), '# diff', chr(10), array_to_string(ls[1:12], chr(10)), chr(10), '… ', len(ls) - 12, ' more lines', CASE WHEN n > taken THEN concat(chr(10), chr(10), '(', n - taken, ' failures are not in this batch)') ELSE '' END) AS payload FROM taken t JOIN runs u ON u.id = t.run_id JOIN diffs d ON d.run_id = t.run_id)
"""


def _run_payload(u, r):
    """The payload of every run with failures: two failures, three files, twelve lines of a diff made from the changed files."""
    bad = r.where(K.failing(F.col("status")))
    part = lambda f: F.concat(F.lit("diff --git a/"), f, F.lit(" b/"), f, F.lit("\n@@ -1 +1,2 @@\n+a\n+b\n"))
    paths = bad.groupBy("run_id").agg(F.array_distinct(F.flatten(F.collect_list(T.referenced_files(F.col("stack"))))).alias("paths"))
    diffs = u.select(F.col("id").alias("run_id"), F.array_join(F.transform("changed_files", part), "").alias("diff")).join(paths, "run_id")
    out = P.payloads(u, P.payload_items(bad), diffs, most=2, files=3, diff_lines=12)
    return out.select("run_id", F.sha2("payload", 256).alias("h"), "tokens", "taken", "omitted")


on_history("run_payload", f", {_RUN_PAYLOAD} SELECT run_id, sha256(payload) AS h, ceil(length(payload) / 4)::BIGINT AS tokens, taken, n - taken AS omitted FROM texts", _run_payload)


def _run_report(u, r):
    told = lambda path: F.get_json_object("report", f"$.{path}")
    long = lambda path: told(path).cast("long")
    return P.run_reports(u, r, verdict_rows(u, r), most=2).select("run_id", told("run.branch").alias("branch"), long("totals.passed").alias("passed"), long("totals.failures").alias("failures"), long("totals.regressions").alias("regressions"), long("buckets.look_soon.n").alias("look_soon"), long("buckets.safe_to_ignore.more").alias("more_safe"), told("buckets.safe_to_ignore.first[0].test").alias("first_safe"), told("buckets.look_soon.first[1].kind").alias("second_look"))


on_history(
    "run_report",
    _FACTS
    + """, totals AS (SELECT run_id, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status IN ('failed', 'error')) AS failures FROM results GROUP BY ALL),
 counts AS (SELECT run_id, count(*) FILTER (WHERE kind = 'real_regression') AS regressions, count(*) FILTER (WHERE bucket = 'look_soon') AS look_soon, count(*) FILTER (WHERE bucket = 'safe_to_ignore') AS safe FROM judged GROUP BY ALL),
 placed AS (SELECT run_id, test_key, kind, bucket, row_number() OVER (PARTITION BY run_id, bucket ORDER BY k, c DESC, id, test_key) AS p FROM judged)
 SELECT u.id AS run_id, u.branch, t.passed, t.failures, coalesce(regressions, 0) AS regressions, coalesce(look_soon, 0) AS look_soon, greatest(coalesce(safe, 0) - 2, 0) AS more_safe, f.test_key AS first_safe, s.kind AS second_look
 FROM runs u JOIN totals t ON t.run_id = u.id LEFT JOIN counts c ON c.run_id = u.id LEFT JOIN placed f ON f.run_id = u.id AND f.bucket = 'safe_to_ignore' AND f.p = 1 LEFT JOIN placed s ON s.run_id = u.id AND s.bucket = 'look_soon' AND s.p = 2""",
    _run_report,
)


def _answered(u, r):
    n = F.col("id") % 4
    kind = F.when(n == 0, "flake_likely").when(n == 1, "real_regression").when(n == 2, "infra_failure").otherwise("broken")
    text = F.to_json(F.struct("test_key", kind.alias("kind"), F.lit("low").alias("confidence"), F.lit("r").alias("one_line_reason"), F.lit("").alias("likely_cause"), F.when(F.col("id") % 5 > 0, "look").alias("suggested_next_step")))
    return P.parse_model_answers(r.select(F.col("id").alias("position"), text.alias("json")))


on_history("model_verdict_parse", "SELECT id AS position, test_key, ['flake_likely', 'real_regression', 'infra_failure', 'broken'][(id % 4 + 1)::INT] AS kind, 'low' AS confidence, id % 4 < 3 AND id % 5 > 0 AS valid FROM results", _answered)


def _report_rows(s, d):
    """Pages as report files: each becomes an XML report with a failure body that holds the page's markup."""
    pages = table(s, d, "pages")
    body = F.concat(F.lit('<testsuite name="pages"><testcase name="p'), F.col("page_id").cast("string"), F.lit('" time="1.5"><failure message="bad page">'), T.escape_html(F.col("html")), F.lit("</failure></testcase></testsuite>"))
    files = pages.select(F.concat(F.lit("junit-"), F.col("page_id").cast("string"), F.lit(".xml")).alias("path"), F.encode(body, "UTF-8").alias("content"))
    rows = analyzed(parse_files(files))
    return rows.select("path", "suite", "name", "test_key", "status", "duration_ms", F.length("failure.stack").alias("n"))


query("parse_reports", "SELECT concat('junit-', page_id, '.xml') AS path, 'pages' AS suite, concat('p', page_id) AS name, sha256(concat('pages::p', page_id)) AS test_key, 'failed' AS status, 1500::BIGINT AS duration_ms, length(html)::INT AS n FROM pages", False)(_report_rows)
query("failures_by_window", "SELECT date_trunc('day', ts) AS start, user_id AS test, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY ALL", False)(lambda s, d: failures_by_window(table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("test"), (F.col("event_type") == "error").alias("failed"))).withColumn("start", F.col("start").cast("timestamp_ntz")))
