"""History store: Parquet tables that only grow, with idempotent appends.

A writer stages an append under a unique batch folder and publishes it by a commit marker; readers take only committed
batches, so a lost job leaves nothing half-visible and a repeated one records nothing twice. One writer at a time
assigns run ids.

Results lie in folders by the first digit of the test's key, sorted by key, so that a look-up of one test reads one
part and in it few row groups. Beside the results each batch keeps a state per test and the first failure of each fingerprint on each branch, from which
a run is judged without reading the history. Small batches are rewritten as one by :meth:`HistoryStore.compact`, whose
marker replaces theirs; readers that began before go on with the old files until :meth:`HistoryStore.vacuum`.

The name of a marker carries the layout's version. Version 1 (no suffix) has neither parts nor states; its batches are
read as they are, columns that it lacks are filled, and compaction rewrites them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StoreVersionError
from ..functions.keys import artifact_regex, failing, rollup, strict
from ..operators import state as S
from ..operators.classify import test_file_candidates, test_file_touched
from ..operators.facts import timeline_facts
from ..operators.history import new_runs
from ..schema import RESULTS, RUNS
from .reports import analyzed, parse_files

VERSION = 2
PRINTS = "fingerprint string, branch string, started_at long, run_id long"
#: Bytes of a file that compaction aims at.
FILE = 128 << 20


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


class HistoryStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        #: The batch that this store wrote last.
        self.last: str | None = None

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _lines(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        reader = self.spark._jvm.java.io.BufferedReader(self.spark._jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
        try:
            return [x for x in iter(reader.readLine, None) if x]
        finally:
            reader.close()

    def _publish(self, batch: str, replaces: list[str] = ()) -> None:
        """One marker makes a batch visible, and those that it replaces invisible: written aside, then renamed."""
        name = f"{batch}.{'c' if replaces else 'v'}{VERSION}"
        fs, aside = self._fs(f"{self.root}/staged/{name}")
        _, p = self._fs(f"{self.root}/commits/{name}")
        fs.mkdirs(aside.getParent())
        fs.mkdirs(p.getParent())
        out = fs.create(aside, False)
        out.write(bytearray("\n".join(replaces).encode()))
        out.close()
        if not fs.rename(aside, p):
            raise OSError(f"batch {batch} could not be published")

    def live(self) -> dict[str, int]:
        """Visible batches and their layout's versions."""
        fs, p = self._fs(f"{self.root}/commits")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        found, gone = {}, set()
        for n in names:
            batch, _, kind = n.partition(".")
            version = int(kind[1:]) if kind[1:].isdigit() else 1 if not kind else VERSION + 1
            if version > VERSION:
                raise StoreVersionError(f"{self.root} was written by a later version (marker {n})")
            found[batch] = version
            if kind.startswith("c"):
                gone.update(self._lines(f"{self.root}/commits/{n}"))
        return {b: v for b, v in found.items() if b not in gone}

    def _read(self, name: str, schema: T.StructType, parted: bool, batches: list[str] | None = None) -> DataFrame:
        live = self.live()
        live = live if batches is None else {b: v for b, v in live.items() if b in batches}
        wide = T.StructType([*schema.fields, T.StructField("batch", T.StringType())] + [T.StructField("part", T.StringType())] * parted)
        frames = []
        for version in sorted(set(live.values())):
            if version == 1 and name not in ("runs", "results"):
                continue
            paths = [f"{self.root}/{name}/batch={b}" for b, v in live.items() if v == version]
            rows = self.spark.read.schema(wide if version > 1 or not parted else T.StructType(wide.fields[:-1])).option("basePath", f"{self.root}/{name}").parquet(*paths)
            frames.append(rows if version > 1 or not parted else rows.withColumn("part", F.substring("test_key", 1, 1)))
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], wide)

    def runs(self, batches: list[str] | None = None) -> DataFrame:
        rows = self._read("runs", RUNS, False, batches)
        return rows.withColumn("changed_files", F.coalesce("changed_files", F.array().cast("array<string>"))).drop("batch")

    def results(self, batches: list[str] | None = None) -> DataFrame:
        """All results; ``part`` is the first digit of the test's key, by which they lie in folders."""
        return self._read("results", RESULTS, True, batches).drop("batch")

    def states(self, batches: list[str] | None = None) -> DataFrame:
        """Per-test states, one row per test and batch."""
        return self._read("states", _schema(S.STATE), True, batches)

    def _write(self, name: str, batch: str, rows: DataFrame, schema: T.StructType, parted: bool, files: int | None = None) -> None:
        rows = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields))
        if parted:
            rows = rows.withColumn("part", F.substring("test_key", 1, 1))
            rows = rows.repartitionByRange(files, "part", "test_key") if files else rows.repartition("part")
            rows = rows.sortWithinPartitions("part", "test_key")
        out = rows.write.mode("overwrite")
        (out.partitionBy("part") if parted else out).parquet(f"{self.root}/{name}/batch={batch}")

    def _prints(self, runs: DataFrame, results: DataFrame) -> DataFrame:
        bad = results.where(failing(F.col("status")) & F.col("fingerprint").isNotNull()).select("fingerprint", "run_id")
        return bad.join(runs.select(F.col("id").alias("run_id"), "branch", "started_at"), "run_id").groupBy("fingerprint", "branch").agg(F.min(F.struct("started_at", "run_id")).alias("t")).select("fingerprint", "branch", "t.*")

    def record(self, runs: DataFrame, results: DataFrame) -> DataFrame:
        """Append runs not recorded yet and their results; returns (given, id) of what was inserted.

        ``runs`` has the columns of the table with ``id`` as the caller's own number, which ``results.run_id`` refers to.
        New ids follow the largest recorded one densely, in order of start and the caller's number.
        """
        batch = uuid.uuid4().hex
        known = self.runs()
        last = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
        fresh = new_runs(runs, known)
        # dense numbers for a batch of runs (one row per build, not per test)
        numbered = fresh.withColumn("given", F.col("id")).withColumn("id", F.row_number().over(W.orderBy("started_at", "id")) + F.lit(last))
        at = f"{self.root}/staged/batch={batch}"
        numbered.write.parquet(at)
        staged = self.spark.read.parquet(at)
        self._write("runs", batch, staged, RUNS, False)
        mine = results.withColumnRenamed("run_id", "given").join(staged.select("given", F.col("id").alias("run_id")), "given")
        self._write("results", batch, mine, RESULTS, True)
        mine = self.spark.read.schema(RESULTS).parquet(f"{self.root}/results/batch={batch}")
        self._write("states", batch, S.states_of(staged, mine), _schema(S.STATE), True)
        self._write("prints", batch, self._prints(staged, mine), _schema(PRINTS), False)
        self._publish(batch)
        self.last = batch
        return staged.select("given", "id")

    def test_states(self, batches: list[str] | None = None) -> DataFrame:
        """One state per test over the batches (all visible ones): merged, or anew from the results where stretches run into each other or have none."""
        live = self.live()
        mine = [b for b in live if batches is None or b in batches]
        if not mine:
            return self.spark.createDataFrame([], _schema(S.STATE))
        names = [f.name for f in _schema(S.STATE).fields]
        known = S.merged(self.states(mine).select(*(f"`{n}`" for n in names)))
        results = self.results(mine)
        old = [b for b in mine if live[b] < 2]
        again = known.where("overlap").select("test_key")
        if old:
            again = again.unionByName(self.results(old).select("test_key")).distinct()
        kept = known.where(~F.col("overlap")).join(again, "test_key", "left_anti") if old else known.where(~F.col("overlap"))
        return kept.select(*names).unionByName(S.states_of(self.runs(mine), results.join(again, "test_key", "left_semi")).select(*names))

    def run_facts(self, run_ids: DataFrame, batch: str, window: int = 30) -> DataFrame:
        """What :func:`testweave.operators.facts.facts` says about the failures of runs of one batch, without reading the history's results.

        Earlier entries come from states, other attempts and the parent from the batches that hold runs of these commits,
        branches from the first failures. Tests whose states reach beyond the runs (recorded late) are read in full.
        """
        live = self.live()
        others = [b for b in live if b != batch]
        runs = self.runs()
        asked = runs.join(run_ids.withColumnRenamed("run_id", "id"), "id", "left_semi")
        about = asked.select(F.col("id").alias("run_id"), "commit_sha", "parent_sha", "branch", "attempt", "started_at", "changed_files")
        mine = self.results([batch])
        per = mine.groupBy("test_key", "run_id").agg(F.max("suite").alias("suite"), rollup(F.col("status")).alias("status"), F.collect_list(F.when(failing(F.col("status")), F.struct("id", "fingerprint"))).alias("failures"))
        all_mine = per.join(self.runs([batch]).select(F.col("id").alias("run_id"), "started_at", "changed_files"), "run_id")
        # the stretch before is what other batches hold; several runs of one batch, or late ones, take the timeline itself
        bad = per.where(F.size("failures") > 0).join(about, "run_id")
        before = self.test_states(others).join(bad.select("test_key").distinct(), "test_key", "left_semi")
        first = all_mine.groupBy("test_key").agg(F.min(F.struct("started_at", "run_id")).alias("first"), F.count(F.lit(1)).alias("own"))
        simple = first.join(before.select("test_key", "upto"), "test_key", "left").where((F.col("own") == 1) & (F.col("upto").isNull() | (F.col("upto") < F.col("first")))).select("test_key")
        touched = test_file_touched(F.col("changed_files"), test_file_candidates(F.lit(None).cast("string"), F.col("suite")))
        entries = bad.join(simple, "test_key", "left_semi").select("test_key", "run_id", strict(F.col("status")).alias("outcome"), touched.alias("touched"))
        line = S.next_run_facts(before, entries, window)
        rest = bad.join(simple, "test_key", "left_anti").select("test_key").distinct()
        whole = self.results().join(rest, "test_key", "left_semi").groupBy("test_key", "run_id").agg(F.max("suite").alias("suite"), rollup(F.col("status")).alias("status"))
        whole = timeline_facts(whole.join(runs.select(F.col("id").alias("run_id"), "started_at", "changed_files"), "run_id"), window)
        line = line.unionByName(whole.join(run_ids, "run_id", "left_semi").select(*line.columns))
        rows = bad.join(line, ["test_key", "run_id"])
        # runs of the commits in question, and the batches that hold them
        shas = about.select(F.explode(F.array_compact(F.array("commit_sha", "parent_sha"))).alias("commit_sha")).distinct()
        near = self._read("runs", RUNS, False).join(shas, "commit_sha", "left_semi").select(F.col("id").alias("run_id"), "commit_sha", F.col("attempt").alias("at"), "started_at", "batch")
        held = [r["batch"] for r in near.select("batch").distinct().collect()]  # batches of two commits per run
        seen = self.results(held).join(near, "run_id").join(bad.select("test_key").distinct(), "test_key", "left_semi").select("test_key", "commit_sha", "at", F.struct("started_at", "run_id").alias("t"), "status")
        me = F.struct("started_at", "run_id")
        look = rows.select("test_key", "run_id", "commit_sha", "parent_sha", "attempt", me.alias("me"))
        other = look.join(seen.where("status = 'passed'"), ["test_key", "commit_sha"]).where((F.col("at") != F.col("attempt")) & (F.col("t") < F.col("me"))).select("test_key", "run_id").distinct().withColumn("passed_elsewhere", F.lit(True))
        parent = look.join(seen.withColumnRenamed("commit_sha", "parent_sha"), ["test_key", "parent_sha"]).where(F.col("t") < F.col("me"))
        outcome = F.when(F.bool_or(failing(F.col("status"))), "fail").when(F.bool_or(F.col("status") == "passed"), "pass")
        parent = parent.groupBy("test_key", "run_id").agg(outcome.alias("parent_outcome"))
        out = rows.join(other, ["test_key", "run_id"], "left").join(parent, ["test_key", "run_id"], "left").withColumn("passed_elsewhere", F.coalesce("passed_elsewhere", F.lit(False)))
        out = out.withColumn("f", F.explode("failures")).select("f.*", *(c for c in out.columns if c not in ("failures", "status")))
        prints = self._read("prints", _schema(PRINTS), False)
        old = [b for b, v in live.items() if v < 2]
        if old:
            prints = prints.drop("batch").unionByName(self._prints(self.runs(old), self.results(old)))
        wanted = out.select("fingerprint", "run_id", me.alias("me")).where("fingerprint is not null").distinct()
        spread = wanted.join(prints.select("fingerprint", "branch", F.struct("started_at", "run_id").alias("t")), "fingerprint").where(F.col("t") < F.col("me")).groupBy("fingerprint", "run_id").agg(F.count_distinct("branch").alias("branches"))
        return out.join(spread, ["fingerprint", "run_id"], "left").withColumn("branches", F.greatest(F.coalesce("branches", F.lit(1)), F.lit(1)).cast("long"))

    def _size(self, name: str, batches: list[str]) -> int:
        total = 0
        for b in batches:
            fs, p = self._fs(f"{self.root}/{name}/batch={b}")
            total += fs.getContentSummary(p).getLength() if fs.exists(p) else 0
        return total

    def compact(self) -> str | None:
        """Rewrite all visible batches as one of the present layout; its name, or nothing where there is nothing to gain."""
        live = self.live()
        if not live or len(live) == 1 and set(live.values()) == {VERSION}:
            return None
        batch, old = uuid.uuid4().hex, sorted(live)
        files = max(16, self._size("results", old) // FILE)
        self._write("runs", batch, self.runs(old).coalesce(max(1, self._size("runs", old) // FILE)), RUNS, False)
        self._write("results", batch, self.results(old), RESULTS, True, files)
        self._write("states", batch, self.test_states(old), _schema(S.STATE), True, max(16, self._size("states", old) // FILE))
        prints = self._read("prints", _schema(PRINTS), False, old).drop("batch")
        past = [b for b in old if live[b] < 2]
        if past:
            prints = prints.unionByName(self._prints(self.runs(past), self.results(past)))
        self._write("prints", batch, prints.groupBy("fingerprint", "branch").agg(F.min(F.struct("started_at", "run_id")).alias("t")).select("fingerprint", "branch", "t.*"), _schema(PRINTS), False)
        self._publish(batch, old)
        return batch

    def vacuum(self) -> int:
        """Delete the files of batches that were replaced or never published; how many. No reader or writer may be at work on them."""
        live, n = set(self.live()), 0
        for name in ("runs", "results", "states", "prints", "staged"):
            fs, p = self._fs(f"{self.root}/{name}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if s.getPath().getName().removeprefix("batch=") not in live:
                    n += bool(fs.delete(s.getPath(), True))
        return n


def backfill(store: HistoryStore, runs: DataFrame, results: DataFrame, cutoff_ms: int | None = None, since: int | None = None) -> dict:
    """Record past runs newest first down to a cutoff; counts of what was seen, skipped and inserted."""
    wanted = runs
    if cutoff_ms is not None:
        wanted = wanted.where(F.col("started_at") >= cutoff_ms)
    if since is not None:
        wanted = wanted.where(F.col("id") < since)
    seen, kept = runs.count(), wanted.count()
    inserted = store.record(wanted, results)
    r = inserted.agg(F.count(F.lit(1)).alias("n"), F.min("given").alias("oldest")).first()
    return {"scanned": seen, "out_of_range": seen - kept, "already_recorded": kept - r["n"], "inserted": r["n"], "oldest": r["oldest"], "stopped": "cutoff" if cutoff_ms is not None and kept < seen else "end"}


def wanted_artifacts(artifacts: DataFrame, name: str = "*") -> DataFrame:
    """Artifacts that have not expired and whose name fits the pattern."""
    return artifacts.where(~F.coalesce("expired", F.lit(False)) & F.col("name").rlike(artifact_regex(name)))


def backfill_archives(store: HistoryStore, runs: DataFrame, artifacts: DataFrame, name: str = "*", cutoff_ms: int | None = None, since: int | None = None) -> dict:
    """Record past runs from the zip archives of their builds; counts of what happened on the way, and why it stopped.

    ``runs`` has the columns of the table, ``artifacts`` run_id, name, expired and content (bytes of a zip). Runs that
    started before ``cutoff_ms`` are out of range; of the others those from ``since`` on are done already, as are recorded
    ones. XML members of fitting artifacts are parsed; a run without any result is left out, so that it can be tried again.
    """
    in_range = runs if cutoff_ms is None else runs.where(F.col("started_at") >= cutoff_ms)
    wanted = in_range if since is None else in_range.where(F.col("id") < since)
    fresh = new_runs(wanted, store.runs())
    files = wanted_artifacts(artifacts, name).join(fresh.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    at = f"{store.root}/staged/parsed={uuid.uuid4().hex}"
    parsed = parse_files(files.select(F.concat(F.col("run_id").cast("string"), F.lit("/"), "name", F.lit(".zip")).alias("path"), "content"))
    parsed.withColumn("run_id", F.substring_index("path", "/", 1).cast("long")).write.parquet(at)
    parsed = store.spark.read.parquet(at)
    # an archive that cannot be read has no member in its path; other reports than XML are not counted
    archive = F.col("error").isNotNull() & ~F.col("path").contains("!")
    xml = parsed.where(F.lower("path").endswith(".xml"))
    rows = analyzed(xml).select(F.xxhash64("path", "ordinal").alias("id"), "run_id", "suite", F.col("name").alias("test_name"), "test_key", "status", "duration_ms", F.col("failure.message").alias("message"), F.col("failure.stack").alias("stack"), "fingerprint")
    given = store.record(fresh.join(rows.select("run_id").distinct().withColumnRenamed("run_id", "id"), "id", "left_semi"), rows)
    recorded = given.select(F.col("given").alias("run_id"))
    n_range, n_wanted, n_fresh, n_recorded = in_range.count(), wanted.count(), fresh.count(), recorded.count()
    stopped = "window" if cutoff_ms is not None and n_range < runs.count() else "since" if since is not None else "exhausted"
    return {
        "scanned": n_range,
        "matched": files.select("run_id").distinct().count(),
        "recorded": n_recorded,
        "already_recorded": n_wanted - n_fresh,
        "results": rows.join(recorded, "run_id", "left_semi").count(),
        "artifacts": files.count(),
        "bad_archives": parsed.where(archive).count(),
        "parse_failures": xml.where(F.col("error").isNotNull()).count(),
        "oldest": wanted.agg(F.min("id").alias("o")).first()["o"],
        "stopped": stopped,
    }
