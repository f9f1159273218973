"""The library stands without its training-data subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from lodeseek.session import shared_folder

ROOT = Path(__file__).resolve().parent.parent


def test_a_cluster_must_name_its_shared_folder(spark):
    """A local session gets a temporary folder; elsewhere one is asked for."""
    assert shared_folder(spark) == shared_folder(spark)
    none = SimpleNamespace(get=lambda key, default: default)
    cluster = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(applicationId="a", master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(cluster)


def test_only_the_subpackage_and_its_pipeline_import_it():
    for file in (ROOT / "lodeseek").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s+\S*llm", file.read_text(), re.M), file


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "lodeseek", tmp_path / "lodeseek", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sum(q in e.oracle_sql() for q in e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=True)
    n, with_sql, pipeline = said.stdout.split()
    assert int(n) == int(with_sql) > 50
    assert pipeline == "False"


def test_entry_with_a_subpackage_that_does_not_import(tmp_path):
    """Not only a missing subpackage: one whose own imports fail takes none of the other queries along."""
    shutil.copytree(ROOT / "lodeseek", tmp_path / "lodeseek", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "lodeseek" / "llm").mkdir()
    (tmp_path / "lodeseek" / "llm" / "__init__.py").write_text("")
    (tmp_path / "lodeseek" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=True)
    n, with_sql = said.stdout.split()
    assert int(n) == int(with_sql) > 50
