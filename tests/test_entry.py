"""The driver's contract."""

import os
import subprocess
import sys
from pathlib import Path

from .conftest import ROOT


def test_entry_and_keys(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def without_subpackage(folder):
    """A copy of the repository, by links, with the subpackage, its tests and the pipeline taken out."""
    for name in os.listdir(ROOT):
        if name not in (".git", "corpus_pipeline.py", "tilewright", "tests", "__spark_entry__.py", ".pytest_cache"):
            (folder / name).symlink_to(Path(ROOT) / name)
    for package in ("tilewright", "tests"):
        (folder / package).mkdir()
        for name in os.listdir(f"{ROOT}/{package}"):
            if name not in ("llm", "__pycache__"):
                (folder / package / name).symlink_to(Path(ROOT) / package / name)
    (folder / "__spark_entry__.py").write_text((Path(ROOT) / "__spark_entry__.py").read_text())
    return {**os.environ, "PYTHONPATH": str(folder)}


def test_runs_without_the_subpackage(tmp_path):
    """The rest still imports, and so do all of its tests."""
    env = without_subpackage(tmp_path)
    code = "import __spark_entry__ as e; n = list(e.queries()); assert n and not any(x.startswith('op') or x == 'pipeline' for x in n); print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=100)
    assert out.returncode == 0, out.stderr
    out = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert out.returncode == 0 and "error" not in out.stdout.lower().splitlines()[-1], out.stdout[-2000:]


def test_a_broken_subpackage_is_an_error(tmp_path):
    env = without_subpackage(tmp_path)
    (tmp_path / "tilewright" / "llm").mkdir()
    (tmp_path / "tilewright" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tilewright" / "llm" / "queries.py").write_text("import not_there_at_all")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=100)
    assert out.returncode != 0 and "not_there_at_all" in out.stderr
