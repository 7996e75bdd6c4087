"""The driver's entry, with and without the subpackage of training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
PRINT = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def names(folder):
    out = subprocess.run([sys.executable, "-c", PRINT], cwd=folder, capture_output=True, text=True, check=True).stdout
    queries, sql = (line.split() for line in out.splitlines())
    return set(queries), set(sql)


def copy(to):
    shutil.copytree(ROOT / "glossa", to / "glossa", ignore=shutil.ignore_patterns("__pycache__"))
    for p in ROOT.glob("*.py"):
        shutil.copy(p, to)
    return to


def engine_only(queries):
    return {q for q in queries if q != "pipeline" and not (q.startswith("op") and q[2].isdigit())}


def test_entry_without_operators(tmp_path):
    """Without their folder, with an empty one, and without the pipeline's module, the other queries stay."""
    whole, sql = names(copy(tmp_path))
    assert sql <= whole and engine_only(whole)
    pipeline = tmp_path / "corpus_pipeline.py"
    for step in (lambda: shutil.rmtree(tmp_path / "glossa/llm", ignore_errors=True), lambda: (tmp_path / "glossa/llm").mkdir(), lambda: pipeline.unlink(missing_ok=True)):
        step()
        queries, left = names(tmp_path)
        assert queries == engine_only(whole) and left <= queries
