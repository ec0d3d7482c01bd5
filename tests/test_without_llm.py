"""The library and its queries work without the subpackage llm."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['foliant.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'retrieve_topk' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_it():
    for path in [*(ROOT / "foliant").rglob("*.py"), *(ROOT / "jobs").rglob("*.py"), ROOT / "tests/test_jobs.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            text = path.read_text()
            assert "foliant.llm" not in text and "corpus_pipeline" not in text, path
