"""The driver's contract."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "tidemark"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'notice_page' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120, check=False).returncode == 0


def test_nothing_outside_imports_the_corpus_operators():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tidemark.llm" not in path.read_text() and "from tidemark import llm" not in path.read_text(), path
