"""The driver's entry file with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROBE = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), *[x for x in q if x == 'pipeline' or x.startswith('op') and x[2].isdigit()])"


def registered(folder):
    run = subprocess.run([sys.executable, "-B", "-c", PROBE], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    n, *names = run.stdout.split()
    return int(n), names


@pytest.mark.parametrize("gone", [["tessella/llm", "tests/llm"], ["tessella/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_stands_without_the_optional_folders(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        (shutil.rmtree if (copy / name).is_dir() else Path.unlink)(copy / name)
    (copy / "tessella/llm/__pycache__").mkdir(parents=True)  # what an interpreter may leave behind
    from tessella.plans.catalog import QUERIES

    assert registered(copy) == (len(QUERIES), [])


def test_a_broken_pipeline_leaves_the_rest(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "llm"))
    (copy / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert registered(copy)[1] == []
