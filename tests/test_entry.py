"""The driver contract, with and without the optional part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def names(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    env = os.environ | {"PYTHONPATH": str(folder)}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_entry_imports_without_the_optional_part(tmp_path):
    shutil.copytree(REPO / "cairn", tmp_path / "cairn", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    with_pipeline = tmp_path / "with"  # whether or not corpus_pipeline.py is left behind
    shutil.copytree(tmp_path / "cairn", with_pipeline / "cairn")
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists():
            shutil.copy(REPO / name, with_pipeline)
    found = names(tmp_path)
    assert found == names(with_pipeline)
    assert "same_size_bands" in found and not any(n.startswith("op") and n[2].isdigit() for n in found)


def test_nothing_outside_names_the_optional_part():
    outside = [p for p in (REPO / "cairn").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in outside if "cairn.llm" in p.read_text()]


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
