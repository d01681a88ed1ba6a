"""The engine stands without the corpus operators, their tests and their pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'scan_sql' in q, any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q, len(e.oracle_sql()))"


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_without_the_corpus_folders(tmp_path, with_pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", *([] if with_pipeline else ["corpus_pipeline.py"])))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", SAY], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    count, core, corpus, pipeline, oracles = said.stdout.split()
    assert int(count) > 50 and int(oracles) > 50 and (core, corpus, pipeline) == ("True", "False", "False")
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert collected.returncode == 0, collected.stdout


def test_nothing_outside_imports_the_corpus_operators():
    for path in (ROOT / "tidelog").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tidelog.llm" not in path.read_text(), path
