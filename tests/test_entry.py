import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 5)} <= set(entry.queries())


def test_core_does_not_need_the_text_operators():
    code = "import sys; sys.modules['barloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p4_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for path in (ROOT / "barloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "barloom.llm" not in path.read_text(), path


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["symbol", "day"]
