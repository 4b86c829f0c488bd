"""The entry module's contract, also without the optional parts."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


def test_the_rest_imports_without_the_corpus_operators():
    code = "import sys; sys.modules['strandlake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


def test_flagship_query(spark, tmp_path):
    orders = spark.sql("select id as o_orderkey, (id * 37) % 100 as o_custkey, 'F' as o_orderstatus, cast(id as double) as o_totalprice, timestamp '2024-01-01' as o_orderdate, 'x' as o_orderpriority from range(0, 2000)")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    from strandlake import catalog

    rows = catalog.QUERIES["q_node_roles"](spark, str(tmp_path)).collect()
    assert rows and {r["role"] for r in rows} <= {"isolated", "leaf", "junction", "turning", "interim_straight"}


def test_broken_corpus_operators_are_an_error():
    code = "import sys; sys.modules['numpy'] = None; import __spark_entry__"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    try:
        import strandlake.llm  # noqa: F401
    except ImportError:
        return
    assert out.returncode != 0


def test_the_folders_may_be_missing(tmp_path):
    import shutil

    shutil.copytree(f"{ROOT}/strandlake", tmp_path / "strandlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
