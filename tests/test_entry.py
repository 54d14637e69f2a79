"""The entry module with and without the corpus folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from testweave.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_loads_without_the_corpus_folders(tmp_path, pipeline):
    keep = shutil.ignore_patterns("llm", "__pycache__", ".git", "spark-warehouse")
    shutil.copytree(ROOT / "testweave", tmp_path / "testweave", ignore=keep)
    for name in ["__spark_entry__.py", "bench.py", *["corpus_pipeline.py"] * (pipeline and (ROOT / "corpus_pipeline.py").exists())]:
        shutil.copy(ROOT / name, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e, bench; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    names, sql = said.stdout.splitlines()
    assert names.split() == sorted(catalog.QUERIES) and sql.split() == sorted(catalog.ORACLES)


def test_all_queries_are_there():
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
