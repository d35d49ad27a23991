"""The library stands without the optional subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "codequery", tmp_path / "codequery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "codequery" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave behind
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    outside = [p for p in (ROOT / "codequery").rglob("*.py") if "llm" not in p.parts]
    assert outside and not [p for p in outside if re.search(r"(from|import)[^\n]*\bllm\b", p.read_text())]
