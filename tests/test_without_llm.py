"""The library and its queries work without the llm folders."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "trailweave", tmp_path / "trailweave", ignore=lambda _, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())))"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    n, extra = said.stdout.split(" ", 1)
    assert said.returncode == 0 and int(n) >= 30 and extra.strip() == "[]"


def test_nothing_else_imports_llm():
    for path in (ROOT / "trailweave").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text())
