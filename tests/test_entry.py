"""The entry point with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def counted(root):
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True)
    return said.returncode, tuple(map(int, said.stdout.split()))


@pytest.mark.parametrize("left", ["nothing", "__pycache__"])
def test_the_rest_stands_alone(tmp_path, left):
    root = tmp_path / "repo"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "tests", "llm", "corpus_pipeline.py", "__pycache__"))
    if left != "nothing":
        (root / "tickframe/llm/__pycache__").mkdir(parents=True)
    code, (queries, oracles) = counted(root)
    assert code == 0 and queries == oracles > 120


def test_a_broken_operator_is_not_passed_over(tmp_path):
    root = tmp_path / "repo"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "tests", "corpus_pipeline.py", "__pycache__", "llm"))
    (root / "tickframe/llm").mkdir()
    (root / "tickframe/llm/__init__.py").write_text("")
    (root / "tickframe/llm/queries.py").write_text("import nothing_of_that_name")
    assert counted(root)[0] != 0
