"""The engine doesn't know the corpus subpackage, and the entry works without it."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_imports_llm():
    for p in (ROOT / "recallweave").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_entry_without_llm(tmp_path):
    import shutil

    shutil.copytree(ROOT / "recallweave", tmp_path / "recallweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(o) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
