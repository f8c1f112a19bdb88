import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_contract():
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and len(names) > 90


def test_nothing_outside_imports_llm():
    for path in (ROOT / "corpusloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "corpusloom.llm" not in path.read_text(), path


def test_entry_works_without_llm(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("corpusloom.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert "p1_found" in e.queries() and not any(q.startswith("p3_") for q in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
