"""Report files in a folder tree: found without entering what cannot hold any, read only where they match.

Folders are listed in tasks. The driver keeps a frontier of at most ``FRONTIER`` folders, opened level by level until
there is enough to deal out; a task then walks what lies below its own. Folders that are never searched, and folders
that no pattern leads into, are not entered. Archives are not read whole: their table of contents gives one row per
member with its place, and members are read by that range, in other tasks than their neighbours.
"""

from __future__ import annotations

import os
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K

#: Default patterns of report files, folders that are never searched.
PATTERNS = ("**/junit*.xml", "**/TEST-*.xml")
SKIPPED = ("node_modules", ".git", ".hg", ".svn", ".venv", "venv", "__pycache__", ".testweave")
#: Folders that the driver holds at once; files a task reads one after another.
FRONTIER, PER_TASK = 4096, 64
FOUND = "path string, size long"
PLACED = "path string, file string, start long, packed long, method int, error string"


def rooted(root: str) -> str:
    """An address as it is, a local path made absolute, without a slash at its end."""
    return (root if "://" in root else os.path.abspath(root)).rstrip("/") or "/"


@lru_cache
def _pattern(*globs: str) -> re.Pattern:
    return re.compile("|".join(K.glob_to_regex(g).removesuffix("\\z") + "\\Z" for g in globs))


def leads_into(folder: str, patterns: tuple[str, ...]) -> bool:
    """Whether a file below ``folder`` (a path below the root) may match a pattern: its segments fit the pattern's first ones."""
    parts = folder.split("/")
    for p in patterns:
        wanted = p.split("/")
        deep = next((i for i, w in enumerate(wanted) if "**" in w), None)
        if deep is None and len(parts) >= len(wanted):
            continue
        upto = min(len(parts), len(wanted) - 1 if deep is None else deep)
        if all(_pattern(w).match(x) for w, x in zip(wanted[:upto], parts[:upto])):
            return True
    return False


def _listed(files: fs.FileSystem, root: str, folder: str) -> list[fs.FileInfo]:
    try:
        return files.get_file_info(fs.FileSelector(f"{root}/{folder}" if folder else root, recursive=False))
    except OSError:  # what cannot be listed holds nothing
        return []


def _walk(root: str, patterns: tuple[str, ...], skipped: tuple[str, ...], folder: str, deep: bool) -> Iterator[tuple[str, int | None]]:
    """(path below the root, size) of matching files; of folders to enter too, with no size, where ``deep`` is false."""
    files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    base = base.rstrip("/")
    match = _pattern(*patterns).match
    left = [folder]
    while left:
        at = left.pop()
        for i in _listed(files, base, at):
            below = f"{at}/{i.base_name}" if at else i.base_name
            if i.type == fs.FileType.Directory:
                if i.base_name not in skipped and leads_into(below, patterns):
                    if deep:
                        left.append(below)
                    else:
                        yield below, None
            elif i.type == fs.FileType.File and match(below):
                yield below, i.size


def discover(spark: SparkSession, root: str, patterns: tuple[str, ...] = PATTERNS, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, size) of the files under ``root`` whose path below it matches a pattern; each once.

    ``root`` is a local path or an address that executors can open. A root that is not there holds nothing.
    """
    root = rooted(root)
    found: list[tuple[str, int | None]] = []
    frontier = [""]

    def listing(deep: bool):
        def run(batches):
            for b in batches:
                for folder in b["folder"].to_pylist():
                    rows = list(_walk(root, patterns, skipped, folder, deep))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["path", "size"])

        return run

    cores = spark.sparkContext.defaultParallelism
    while frontier and len(frontier) < 8 * cores:
        here = spark.createDataFrame([(f,) for f in frontier], "folder string").repartition(min(len(frontier), cores))
        rows = here.mapInArrow(listing(False), FOUND).limit(FRONTIER + 1).collect()
        if len(rows) > FRONTIER:  # wide folders go to the tasks as they are
            break
        found += [(r.path, r.size) for r in rows if r.size is not None]
        frontier = [r.path for r in rows if r.size is None]
    out = spark.createDataFrame(found, FOUND)
    if frontier:
        rest = spark.createDataFrame([(f,) for f in frontier], "folder string").repartition(min(len(frontier), 8 * cores))
        out = out.unionByName(rest.mapInArrow(listing(True), FOUND))
    return out.select("path", "size")


def _opened(root: str, path: str):
    files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    return files.open_input_file(f"{base.rstrip('/')}/{path}")


def placed(files: DataFrame, root: str) -> DataFrame:
    """What is to be read: a row per file, or per XML or JSON member of an archive (path ``archive!member``), with its place in it.

    Only an archive's table of contents is read here. An archive that cannot be read gives a row with ``error``.
    """
    root = rooted(root)

    def run(batches):
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        for b in batches:
            rows = []
            for path in b["path"].to_pylist():
                if not path.lower().endswith(".zip"):
                    rows.append((path, path, None, None, None, None))
                    continue
                try:
                    with _opened(root, path) as f, zipfile.ZipFile(f) as z:
                        rows += [(f"{path}!{i.filename}", path, i.header_offset, i.compress_size, i.compress_type, None) for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith((".xml", ".json"))]
                except (zipfile.BadZipFile, NotImplementedError, EOFError, OSError, ValueError, struct.error) as e:
                    rows.append((path, path, None, None, None, f"bad archive: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=[c.split()[0] for c in PLACED.split(", ")])

    return files.select("path").mapInArrow(run, PLACED)


def member(f, start: int, packed: int, method: int) -> bytes:
    """The bytes of an archive's member, from its own header on."""
    f.seek(start)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no member there")
    names = sum(struct.unpack_from("<HH", head, 26))
    f.seek(start + 30 + names)
    data = f.read(packed)
    if method == zipfile.ZIP_STORED:
        return data
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(data, -15)
    raise ValueError(f"packing method {method} is not supported")


def contents(root: str, batch: pa.RecordBatch) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path, bytes, error) of placed rows, one at a time; of one archive's members the file is opened once."""
    last = f = None
    try:
        for path, file, start, packed, method, error in zip(*(batch[c].to_pylist() for c in ("path", "file", "start", "packed", "method", "error"))):
            if error:
                yield path, None, error
                continue
            try:
                if file != last:
                    if f is not None:
                        f.close()
                    last, f = None, _opened(root, file)
                    last = file
                yield path, f.read() if start is None else member(f, start, packed, method), None
            except (OSError, ValueError, zlib.error) as e:
                yield path, None, f"{'bad archive' if start is not None else 'cannot be read'}: {e}"
    finally:
        if f is not None:
            f.close()


def dealt(rows: DataFrame) -> DataFrame:
    """Placed rows in tasks of about ``PER_TASK``, neighbours apart: members of one archive are spread over tasks."""
    spark = rows.sparkSession
    n = rows.count()
    return rows.repartition(max(1, min(-(-n // PER_TASK), 64 * spark.sparkContext.defaultParallelism)), F.xxhash64("path"))
