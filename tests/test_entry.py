"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_nothing_imports_the_corpus_operators():
    for f in (ROOT / "annolyte").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            text = f.read_text()
            assert "annolyte.llm" not in text and "from .llm" not in text and "from ..llm" not in text


def test_flagship(spark):
    import __spark_entry__ as e

    if Path(e.SMOKE_DIR).exists():
        row = e.entry(spark).first()
        assert row.cases > 0 and 0 <= row.precision <= 1
