"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary one is made, but only on a single machine (a local master); on a cluster that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Shuffle files of a finished write are of no further use: what was written is read again instead.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and that no later step reads."""
    for t in tables:
        path = _paths.pop(t, None)
        if path is not None:
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the corpus: always sorted and shuffled, never a broadcast, so that it runs alike at every size."""
    return left.join(right.hint("merge"), on, how)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, prefixed until no column of ``df`` is called so (in either case of letters)."""
    taken = {c.lower() for c in df.columns}
    prefix = "_"
    while any(prefix + n in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def filtered(rows: DataFrame, keys: DataFrame, columns: list[str], bits: int = 1 << 25) -> DataFrame:
    """``rows`` without most of those whose columns are in no row of ``keys``: a filter ahead of their join, never in its place.

    The keys' hashes set bits of one bitmap of fixed size (4 MB by default), which is all that reaches the driver and the
    tasks; with more keys than bits it only lets more rows through.
    """
    import numpy as np

    place = F.pmod(F.xxhash64(*columns), F.lit(bits)) + 1
    parts = keys.select(place.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("b")).collect()
    size = len(parts[0]["b"]) if parts else 4096
    bitmap = np.zeros(bits // 8 // size * size + size, np.uint8)
    for r in parts:
        bitmap[(r["k"] - 1) * size : r["k"] * size] = np.frombuffer(bytes(r["b"]), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        found = shared.value
        for b in batches:
            x = b["_x"].to_numpy()
            yield b.filter(pa.array(found[x >> 3] >> (x & 7).astype(np.uint8) & 1 == 1)).drop_columns(["_x"])

    return rows.withColumn("_x", place - 1).mapInArrow(run, rows.schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to few rows, of ``size`` bytes on average at most, so that a task holds few whole texts at a time."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def text_buffers(col: pa.Array):
    """(bytes as numpy uint8, offsets) of a string column, nulls as empty, offsets from 0."""
    import numpy as np

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]
