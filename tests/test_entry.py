"""Every registered core query against its SQL, and the entry points without the text subpackage."""

import subprocess
import sys

import duckdb
import pytest

from weftline import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf_dir, sql, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows = [r.asDict() for r in df.collect()]
    assert rows
    if name in queries.ORACLES:
        want = sql.execute(queries.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        key = lambda r: [str(r[c]) for c in sorted(columns)]
        assert sorted(map(key, rows)) == sorted(key(dict(zip(columns, r))) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_text_operators(tmp_path):
    """The library imports without weftline.llm and corpus_pipeline."""
    import shutil
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copytree(root / "weftline", tmp_path / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cosine_topk' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
