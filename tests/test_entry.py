"""The driver's entry points, with and without the parts that may be taken away."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_every_query_of_the_catalogue_has_sql():
    from heronry.plans import catalogue

    assert set(catalogue.QUERIES) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["doc_id", "score", "gather_rank", "rank"] and got.count() > 0


def test_the_rest_stands_without_the_llm_folder_and_the_pipeline(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "heronry", tmp_path / "heronry", ignore=shutil.ignore_patterns("__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"
    shutil.rmtree(tmp_path / "heronry" / "llm", ignore_errors=True)
    for _ in range(2):
        ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
        assert ran.returncode == 0, ran.stderr
        assert ran.stdout.strip().endswith("[]") and not ran.stdout.startswith("0")
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_nothing_else_imports_the_llm_folder():
    own = [p for p in (ROOT / "heronry").rglob("*.py") if "llm" not in p.parts]
    assert own and not [p for p in own if "heronry.llm" in p.read_text()]
