"""The driver contract, with and without the subpackage for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "marketlens", tmp_path / "marketlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    found = names(tmp_path)
    assert "flagship_top_pages" in found and not any(n.startswith("op") for n in found)


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["session_id", "category", "url", "score", "rank"] and df.count() > 0
