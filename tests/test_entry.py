"""The entry points hold with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
BLOCK = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("stridelake.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "clip_metrics" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_without_the_subpackage():
    subprocess.run([sys.executable, "-c", BLOCK], cwd=REPO, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in REPO.glob("stridelake/**/*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()
