import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_names_and_sql_agree():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and __spark_entry__.catalogue.FLAGSHIP in queries


def test_it_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n[:2] == 'op' or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", check=True)


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.parts and path.name not in ("corpus_pipeline.py", "__spark_entry__.py", "test_entry.py"):
            assert "tercet.llm" not in path.read_text() and "from .llm" not in path.read_text(), path
