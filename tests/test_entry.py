"""The entry points with and without the corpus folders, and the collection of all tests."""

import os
import shutil
import subprocess
import sys

import pytest

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sum(n.startswith('op') for n in q))"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_import_without_corpus_folders(tmp_path, with_pipeline):
    shutil.copytree(f"{HOME}/tablegauge", tmp_path / "tablegauge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HOME}/__spark_entry__.py", tmp_path)
    if with_pipeline and os.path.exists(f"{HOME}/corpus_pipeline.py"):
        shutil.copy(f"{HOME}/corpus_pipeline.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    queries, corpus = map(int, run.stdout.split()[-2:])
    assert queries > 200 and corpus == 0


def test_an_error_inside_the_corpus_folder_is_not_hidden(tmp_path):
    shutil.copytree(f"{HOME}/tablegauge", tmp_path / "tablegauge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HOME}/__spark_entry__.py", tmp_path)
    os.mkdir(tmp_path / "tablegauge/llm")
    (tmp_path / "tablegauge/llm/__init__.py").write_text("")
    (tmp_path / "tablegauge/llm/queries.py").write_text("import a_module_that_is_not_there\n")
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode != 0 and "a_module_that_is_not_there" in run.stderr


def test_all_tests_are_collected():
    run = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests"],
                         cwd=HOME, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-2000:]
