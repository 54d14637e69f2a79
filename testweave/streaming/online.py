"""Streaming extension: report files as they arrive, and flips per test kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.reports import analyzed, parse_files


def report_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of analyzed results from files that arrive in ``folder``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return analyzed(parse_files(files))


def failures_by_window(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Passes and failures per test and time window (ts, test, failed), rows later than ``late`` left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "test").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failures")).select(F.col("window.start").alias("start"), "test", "n", "failures")


def online_flips(events: DataFrame) -> DataFrame:
    """Running number of runs and flips per test (test, ts, failed), by state that holds the last outcome only."""

    def update(key, batches, state):
        import pandas as pd

        n, flips, last = state.get if state.exists else (0, 0, None)
        rows = pd.concat(list(batches)).sort_values("ts")
        for failed in rows["failed"].tolist():
            flips += last is not None and failed != last
            last, n = bool(failed), n + 1
        state.update((n, flips, last))
        yield pd.DataFrame({"test": [key[0]], "n": [n], "flips": [flips]})

    return events.groupBy("test").applyInPandasWithState(update, "test long, n long, flips long", "n long, flips long, last boolean", "update", "NoTimeout")
