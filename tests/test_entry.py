"""The driver's contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "query_id" in df.columns


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_imports_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "quern").rglob("*.py"):
        if "llm" not in p.parts:
            assert "quern.llm" not in p.read_text(), p
