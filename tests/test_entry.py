"""Driver contract: entry() runs, every query has a callable, oracle keys are a subset."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.abspath(E.__file__))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "bucket" in df.columns


def test_registry_shape():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


@pytest.mark.parametrize("gone", [("ledgerwise/llm",), ("corpus_pipeline.py",), ("ledgerwise/llm", "corpus_pipeline.py")])
def test_entry_imports_without_the_training_data_part(tmp_path, gone):
    """A copy of the library without the subpackage, the pipeline or both still registers the rest."""
    skip = shutil.ignore_patterns("__pycache__")
    shutil.copytree(f"{ROOT}/ledgerwise", tmp_path / "ledgerwise", ignore=lambda d, names: {
        *skip(d, names), *(n for n in names if os.path.relpath(os.path.join(d, n), ROOT) in gone)})
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path / name)
    code = "import __spark_entry__ as E; print(len(E.queries()), 'pipeline' in E.queries(), *[k for k in E.queries() if k[:2] == 'op'])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    n, pipeline, *ops = done.stdout.split()
    assert int(n) >= 100 and pipeline == "False"
    assert bool(ops) == ("ledgerwise/llm" not in gone and os.path.isdir(f"{ROOT}/ledgerwise/llm"))
