"""Every query with an oracle gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from plumbline import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    made = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        made.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return made


def rows(df):
    plain = lambda v: None if pd.isna(v) else round(float(v), 3) if isinstance(v, int | float) or getattr(getattr(v, "dtype", None), "kind", "") in "if" and hasattr(v, "dtype") else str(v)
    return sorted(str([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, sf_dir, name):
    made = registry.queries()[name](spark, sf_dir).toPandas()
    if name in registry.oracle_sql():
        assert rows(made) == rows(con.sql(registry.oracle_sql()[name]).df())
    else:
        assert len(made)


def test_entry_without_training_data(spark, monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as entry

    assert set(entry.queries()) == set(registry.queries())
    assert entry.entry(spark).count() == 25
