"""The driver's contract, with and without the llm subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["l_returnflag", "l_extendedprice_sum", "l_extendedprice_mean", "n"] and out.count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_engine_stands_alone(tmp_path):
    for name in ("sparrowgrid", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "sparrowgrid" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e, sparrowgrid; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert len(q) > 100 and set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
