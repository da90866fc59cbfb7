"""The analytics part stands without the corpus part."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
NAMES = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("without", [[], ["corpus_pipeline.py"]])
def test_entry_without_the_corpus_folders(tmp_path, without):
    def skipped(folder, names):
        here = pathlib.Path(folder).relative_to(ROOT)
        return [n for n in names if str(here / n) in {"visitlens/llm", "tests", ".git", *without} or n == "__pycache__"]

    shutil.copytree(ROOT, tmp_path / "copy", ignore=skipped)
    ran = subprocess.run([sys.executable, "-c", NAMES], cwd=tmp_path / "copy", capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr
    names = ran.stdout.split()
    assert "ols" in names and not [n for n in names if n.startswith("op") or n == "pipeline"]


def test_nothing_else_imports_the_corpus_part():
    """Only the entry's guard and the pipeline may name it."""
    files = [f for f in ROOT.rglob("*.py") if not {"llm", ".git"} & set(f.relative_to(ROOT).parts) and f.name not in ("corpus_pipeline.py", "__spark_entry__.py", "test_isolation.py")]
    assert len(files) > 30
    assert [f for f in files if "visitlens.llm" in f.read_text()] == []
