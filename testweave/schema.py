"""Fixed schemas of the history tables and of what the parsers return."""

from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
_failure = T.StructType([T.StructField("message", _S), T.StructField("type", _S), T.StructField("stack", _S)])

RUNS = T.StructType(
    [T.StructField("id", _L, False), T.StructField("repo", _S, False), T.StructField("commit_sha", _S, False), T.StructField("parent_sha", _S), T.StructField("branch", _S)]
    + [T.StructField("ci_run_id", _S), T.StructField("attempt", _I, False), T.StructField("started_at", _L, False), T.StructField("changed_files", T.ArrayType(_S))]
)
RESULTS = T.StructType(
    [T.StructField("id", _L, False), T.StructField("run_id", _L, False), T.StructField("suite", _S), T.StructField("test_name", _S), T.StructField("test_key", _S), T.StructField("status", _S)]
    + [T.StructField("duration_ms", _L), T.StructField("message", _S), T.StructField("stack", _S), T.StructField("fingerprint", _S)]
)
PARSED = T.StructType(
    [T.StructField("path", _S), T.StructField("ordinal", _I), T.StructField("suite", _S), T.StructField("name", _S), T.StructField("status", _S), T.StructField("duration_ms", _L), T.StructField("file", _S)]
    + [T.StructField("failure", _failure), T.StructField("skip_reason", _S), T.StructField("retries", T.ArrayType(_failure)), T.StructField("error", _S)]
)
HUNKS = T.StructType([T.StructField("ordinal", _I), T.StructField("file", _S), T.StructField("new_start", _I), T.StructField("new_lines", _I), T.StructField("changed_lines", T.ArrayType(_I))])
MODEL_VERDICT = T.StructType([T.StructField(n, _S) for n in ("test_key", "kind", "confidence", "one_line_reason", "likely_cause", "suspect_location", "suggested_next_step")])
