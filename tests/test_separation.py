"""The library without the training-data operators: a copy from which both their folders are deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]
ASKED = """
import sys
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names and "recon_exact_match" in names
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), names
assert not any("llm" in m for m in sys.modules if m.startswith("quittance")), "llm was imported"
"""


def test_without_training_data_operators(tmp_path):
    for part in ("quittance", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / part).is_dir():
            shutil.copytree(ROOT / part, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__", "llm"))
        elif (ROOT / part).exists():
            shutil.copy(ROOT / part, tmp_path / part)
    for gone in (False, True):  # the pipeline's file may stay or go
        if gone:
            (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", ASKED], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_them():
    files = [f for f in (ROOT / "quittance").rglob("*.py") if "llm" not in f.parts]
    assert files and not any("llm" in line for f in files for line in f.read_text().splitlines() if line.lstrip().startswith(("import ", "from ")))
