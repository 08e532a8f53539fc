"""The entry with and without the subpackage that may be taken away."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_llm(tmp_path, pipeline):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    env = os.environ | {"PYTHONPATH": str(tmp_path / "repo")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, sql = json.loads(done.stdout)
    assert len(queries) > 90 and set(sql) < set(queries)
    assert not any(q.startswith("op") or q == "pipeline" for q in queries)
