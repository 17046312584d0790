import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["x", "y", "stop_sec"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_part(tmp_path):
    """The rest imports when the corpus subpackage is gone."""
    root = Path(entry.__file__).parent
    for name in ("wakeline", "__spark_entry__.py"):
        source, target = root / name, tmp_path / name
        if source.is_dir():
            import shutil

            shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            target.write_text(source.read_text())
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join([str(tmp_path), *[p for p in sys.path if "site-packages" in p]])})
    n, m = map(int, out.stdout.split())
    assert n > 50 and m > 45
