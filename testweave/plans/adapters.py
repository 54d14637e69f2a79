"""The driver's tables read as a test history: orders are runs, line items are results.

The columns are written as SQL expressions that Spark and DuckDB read alike, so that queries and their oracles start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A third of the tests is steady: they fail seldom and each time in a way of its own. The others are noisy.
STATUS = "CASE WHEN l_partkey % 3 = 1 THEN CASE WHEN l_suppkey % 8 = 7 AND l_quantity > 40 THEN 'failed' ELSE 'passed' END WHEN l_linestatus = 'O' THEN 'passed' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'error' ELSE 'skipped' END"
FAILS = f"({STATUS}) IN ('failed', 'error')"
TEST = "concat('part', CAST(l_partkey AS STRING))"
SUITE = "concat('tests.suite', CAST(l_partkey % 10 AS STRING))"
KEY = f"concat({SUITE}, '::', {TEST})"
#: Failure texts with something volatile in each; a few kinds name the infrastructure.
MESSAGE = """CASE CAST(l_suppkey % 8 AS INT)
 WHEN 0 THEN concat('Error: connect ECONNREFUSED 127.0.0.1:', CAST(1000 + l_partkey AS STRING))
 WHEN 1 THEN concat('timeout after ', CAST(l_partkey AS STRING), ' seconds')
 WHEN 2 THEN concat('AssertionError: expected ', CAST(l_suppkey % 16 AS STRING), ' to equal 7 in run 0x00ff', CAST(1000 + l_orderkey % 9000 AS STRING))
 WHEN 3 THEN concat('step took 12', CAST(l_linenumber AS STRING), 'ms at 2024-01-02T03:04:0', CAST(l_linenumber AS STRING), 'Z')
 WHEN 4 THEN concat('upstream said 503 with status unavailable, password=hunter', CAST(l_partkey AS STRING))
 WHEN 5 THEN concat('TypeError: cannot read /tmp/run', CAST(l_orderkey AS STRING), '/state.json')
 WHEN 6 THEN concat('KeyError: id 123e4567-e89b-12d3-a456-4266141740', CAST(10 + l_linenumber AS STRING))
 ELSE 'ValueError: wrong total' END"""
STACK = "concat('Error: it broke', chr(10), '    at check (src/part', CAST(l_partkey % 40 AS STRING), '.py:', CAST(l_linenumber * 7 AS STRING), ':3)', chr(10), '    at run (node_modules/runner/index.js:5:1)', chr(10), '    at main (lib/helper', CAST(l_suppkey % 5 AS STRING), '.py:12:1)')"
#: One kind of failure has a fingerprint of its own per row, so its spread says nothing.
PRINT = "CASE WHEN l_suppkey % 8 = 7 THEN concat('one', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) ELSE concat('fp', CAST(l_suppkey % 50 AS STRING), '-', l_returnflag) END"


def _runs(array: str) -> str:
    return f"""SELECT o_orderkey AS id, 'demo' AS repo, concat('c', CAST(o_custkey % 150 AS STRING)) AS commit_sha, concat('c', CAST(o_custkey % 150 - 1 AS STRING)) AS parent_sha, o_orderpriority AS branch,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('ci', CAST(o_orderkey % 5000 AS STRING)) END AS ci_run_id, CAST(o_orderkey % 4 + 1 AS INT) AS attempt, CAST(datediff_days AS BIGINT) * 86400000 AS started_at,
 {array}(concat('src/part', CAST(o_orderkey % 40 AS STRING), '.py'), concat('tests/suite', CAST(o_orderkey % 10 AS STRING), '.py'), {', '.join(f"concat('src/part', CAST((o_orderkey + {k}) % 40 AS STRING), '.py')" for k in (3, 7, 13, 22, 31))}) AS changed_files"""


def _results(sha: str) -> str:
    return f"""SELECT l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey AS id, l_orderkey AS run_id, {SUITE} AS suite, {TEST} AS test_name, {sha}({KEY}) AS test_key, {STATUS} AS status,
 CAST(l_quantity * 100 AS BIGINT) AS duration_ms, CASE WHEN {FAILS} THEN {MESSAGE} END AS message, CASE WHEN {FAILS} THEN {STACK} END AS stack, CASE WHEN {FAILS} THEN {PRINT} END AS fingerprint"""


#: Common table expressions for the oracles.
CTE = f"""WITH runs AS ({_runs('list_value').replace('datediff_days', "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))")} FROM orders),
results AS ({_results('sha256')} FROM lineitem),
joined AS (SELECT r.*, u.repo, u.commit_sha, u.parent_sha, u.branch, u.ci_run_id, u.attempt, u.started_at, u.changed_files FROM results r JOIN runs u ON u.id = r.run_id),
rolled AS (SELECT test_key, run_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'passed') THEN 'passed' ELSE 'skipped' END AS status FROM results GROUP BY ALL)
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _runs("array").replace("datediff_days", "datediff(CAST(o_orderdate AS DATE), DATE '1970-01-01')")
    return spark.sql(text + " FROM {t}", t=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where its files have fewer row groups than there are cores: these tables have one each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_results("sha2_256").replace("sha2_256(", "sha2(").replace(f"sha2({KEY})", f"sha2({KEY}, 256)") + " FROM {t}", t=spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
