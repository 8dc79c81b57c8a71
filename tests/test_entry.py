"""The registry with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*sorted(q))"


def names(folder) -> set[str]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", NAMES], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return set(said.stdout.split())


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_load_without_corpus_operators(tmp_path, pipeline):
    """Without the two folders, and with or without the pipeline's file, every other query is still there."""
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    whole, rest = names(ROOT), names(tmp_path / "repo")
    assert len(rest) > 150 and rest == {n for n in whole if n not in ("pipeline", "quality_ablations") and not (n.startswith("op") and n[2].isdigit())}
