import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import pytest

ROOT = Path(entry.__file__).resolve().parent


def test_flagship_runs_and_is_registered(spark):
    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("gone", [("plumbline/llm", "tests/llm"), ("plumbline/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_corpus_part(tmp_path, gone):
    """A copy of the code with the corpus folders deleted still lists all other queries, and nothing in it imports them."""
    for name in ("plumbline", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif src.exists():
            shutil.copy(src, tmp_path / name)
    for name in gone:
        target = tmp_path / name
        if target.is_dir():
            shutil.rmtree(target)
        elif target.exists():
            target.unlink()
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    from plumbline.plans import registry

    assert out[-3:] == [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL)), "False"]
    assert not [p for p in tmp_path.rglob("*.py") if "plumbline.llm" in p.read_text() and p.name not in ("__spark_entry__.py", "corpus_pipeline.py", "test_entry.py")]
