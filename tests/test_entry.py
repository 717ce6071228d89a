"""The driver's contract, and independence from the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]

    def cell(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return str([cell(x) for x in v])
        if pd.isna(v):
            return None
        return round(float(v), 9) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


def names():
    from tracewright.plans import queries

    return sorted(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = entry.queries()[name](spark, SMALL)
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.toPandas()) == canonical(want)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rule_scan' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)
