"""The entry points, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from gridlark.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())), any(x.startswith('op') or x == 'pipeline' for x in e.queries()))"


@pytest.mark.parametrize("gone", [["gridlark/llm"], ["gridlark/llm", "corpus_pipeline.py"]])
def test_entry_without_training_data_operators(tmp_path, gone):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "metastore_db"))
    for name in gone:
        here = at / name
        if here.is_dir():
            shutil.rmtree(here)
        elif here.exists():
            here.unlink()
    env = {**os.environ, "PYTHONPATH": str(at)}
    got = subprocess.run([sys.executable, "-c", ASK], cwd=at, env=env, capture_output=True, text=True, timeout=120, check=True)
    assert got.stdout.split() == [str(len(QUERIES)), "[]", "False"]
