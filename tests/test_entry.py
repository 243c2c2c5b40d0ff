"""The entry module, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_operators(tmp_path):
    for name in ("scriptorium", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q)); assert not any(n.startswith('op') for n in e.oracle_sql() if n[2].isdigit()) and 'pipeline' not in q"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and int(said.stdout) > 50, said.stderr
