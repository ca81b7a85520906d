"""The rest works without the training-data operators."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def _copy(to: Path) -> None:
    shutil.copytree(ROOT / "snapquarry", to / "snapquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", to)


def _names(at: Path) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=at, capture_output=True, text=True)


def test_entry_without_the_subpackage(tmp_path):
    _copy(tmp_path)
    done = _names(tmp_path)
    assert done.returncode == 0, done.stderr
    assert "dedup_ratio" in done.stdout and "op1_" not in done.stdout


def test_other_import_errors_are_not_hidden(tmp_path):
    _copy(tmp_path)
    (tmp_path / "snapquarry/llm").mkdir()
    (tmp_path / "snapquarry/llm/__init__.py").touch()
    (tmp_path / "snapquarry/llm/queries.py").write_text("import no_such_module_anywhere\n")
    assert "no_such_module_anywhere" in _names(tmp_path).stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "snapquarry").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
