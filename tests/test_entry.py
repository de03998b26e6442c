"""The driver's contract, and that everything else works without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_contract(spark):
    import __spark_entry__ as e

    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries)
    assert e.entry(spark).count() > 0


def test_without_the_llm_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'episode_features' in q and not [n for n in q if n[:2] == 'op' and n[2].isdigit()], q; print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120, check=False)
    assert out.returncode == 0, out.stderr
    # A third of the suite, queries of the entry among it, runs there as well.
    some = [sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests", "--ignore", "tests/test_entry.py", "-k", "test_oracle and role or test_text or test_draft or test_task or test_store"]
    out = subprocess.run(some, cwd=copy, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert out.returncode == 0, out.stdout[-2000:]


@pytest.mark.skipif(not (ROOT / "sessionloom/llm").exists(), reason="without the folder")
def test_a_broken_llm_folder_is_not_passed_over(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    (copy / "sessionloom/llm/common.py").write_text("import a_module_that_is_not_there\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=copy, env=env, capture_output=True, text=True, timeout=120, check=False)
    assert out.returncode != 0 and "a_module_that_is_not_there" in out.stderr


def test_nothing_else_imports_llm():
    for path in (ROOT / "sessionloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
