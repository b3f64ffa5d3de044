"""Every query against its DuckDB counterpart, whole results, on the smallest data set."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_of_the_suite_has_an_oracle():
    from suite import GROUPS

    assert {name for group in GROUPS for name in group.QUERIES} <= set(ORACLES) <= set(QUERIES)


def test_entry_point_without_the_llm_folder(tmp_path):
    """A copy of the repository that lacks the operators for training data, and one that lacks the pipeline too."""
    here = os.path.dirname(os.path.abspath(entry.__file__))
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".*")
    for name, more in (("folders", ()), ("pipeline", ("corpus_pipeline.py",))):
        copy = tmp_path / name
        shutil.copytree(here, copy, ignore=lambda d, names, more=more: {*skip(d, names), *more})
        code = "import __spark_entry__ as e; from suite import GROUPS; assert set(e.queries()) == {n for g in GROUPS for n in g.QUERIES} and e.oracle_sql()"
        subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(copy)})


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_result(spark, duck, name):
    assert compare(QUERIES[name](spark, SF), duck, ORACLES[name]) is None
