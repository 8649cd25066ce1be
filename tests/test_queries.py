"""Every query with SQL gives what DuckDB gives, and the entry point stands without the text subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from readloom import queries

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).parent.parent


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in queries.TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(df):
    cols = sorted(df.columns)
    value = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return cols, sorted((tuple(value(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_and_sql_agree(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(queries.ORACLES[name]).df())


def test_queries_without_sql_run(spark):
    for name in set(queries.QUERIES) - set(queries.ORACLES):
        assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_text_operators(tmp_path):
    """A copy without them, as the repository may be left."""
    (tmp_path / "readloom").mkdir()
    for p in REPO.glob("readloom/*"):
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "readloom" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'workflow_parity' in q and not any(n.startswith('op') or n == 'pipeline' for n in q if n != 'orphan_r2' and not n.startswith('overlap')); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, timeout=120)
