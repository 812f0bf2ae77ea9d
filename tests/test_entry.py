"""The driver's contract, also without the optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(n[:2] == 'op' for n in q), 'pipeline' in q)"


def names(folder):
    out = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    return out.stdout.split()[-3:]


def copy(to, *skip):
    shutil.copytree(ROOT / "veristry", to / "veristry", ignore=shutil.ignore_patterns(*skip, "__pycache__") if skip else shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", to)


def test_imports_without_the_optional_parts(tmp_path):
    copy(tmp_path, "llm")
    n, ops, pipeline = names(tmp_path)
    assert int(n) > 120 and ops == "0" and pipeline == "False"


def test_errors_inside_the_optional_parts_are_not_hidden(tmp_path):
    copy(tmp_path, "llm")
    (tmp_path / "veristry/llm").mkdir()
    (tmp_path / "veristry/llm/__init__.py").write_text("")
    (tmp_path / "veristry/llm/queries.py").write_text("import no_such_module")
    assert subprocess.run([sys.executable, "-B", "-c", CODE], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True).returncode


def test_entry_gives_rows(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["nces_id", "hits", "composite", "confidence", "band"] and out.count() > 0
