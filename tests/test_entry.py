"""The driver's contract, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"


def ask(folder):
    return tuple(map(int, subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, check=True).stdout.split()))


def test_the_rest_stands_without_the_subpackage(tmp_path):
    total, optional = ask(ROOT)
    for name in ("quillwatch", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "quillwatch/llm", ignore_errors=True)
    assert ask(tmp_path) == (total - optional, 0)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["page_id", "scanned_url", "overall_status", "critical_count", "warning_count", "info_count"] and df.count() == 50
