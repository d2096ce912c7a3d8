"""The entry point with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_works_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_entry_works_where_the_corpus_operators_lack_a_library(tmp_path):
    (tmp_path / "xxhash.py").write_text("raise ImportError('not there')")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{ROOT}"}, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_subpackage():
    others = [p for p in (ROOT / "tessera").rglob("*.py") if "llm" not in p.relative_to(ROOT / "tessera").parts]
    assert others and not any("tessera.llm" in p.read_text() for p in others)


def test_entry_query(spark):
    import pytest

    import __spark_entry__ as e

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no driver tables")
    rows = e.entry(spark).collect()
    assert {r.method_id for r in rows} == {"m0", "m1"}
