import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"

sys.path.insert(0, str(ROOT))
import __spark_entry__  # noqa: E402


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "ab_core_components" in queries


def test_entry_without_the_corpus_operators(tmp_path):
    """The rest imports and registers its queries when the subpackage and the pipeline are gone."""
    shutil.copytree(ROOT / "corelens", tmp_path / "corelens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ab_skyline' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "corelens").rglob("*.py"):
        if "llm" not in path.parts:
            assert "corelens.llm" not in path.read_text()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["ml_edge_counts_rollup", "ab_core_members", "ab_core_components", "kl_core_zero_l", "ml_core_components", "ab_skyline", "kl_skyline", "ab_batch_components", "block_boxes", "box_measures", "ab_after_both"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns, rows = [d[0] for d in found.description], found.fetchall()
    df = __spark_entry__.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
