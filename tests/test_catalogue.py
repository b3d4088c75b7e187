"""Every registered query against its SQL in DuckDB, and what the driver asks of the entry."""

import duckdb
import pytest

import __spark_entry__ as library
from quillwork.plans import catalogue

TABLES = ["documents", "benchmark", "conversations", "events", "labels"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if type(v).__name__ in ("datetime", "Timestamp", "Decimal") else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = catalogue.queries()[name](spark, sf_dir)
    wanted = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    key = lambda row: tuple((v is None, str(type(v)), str(v)) for v in row)
    a = sorted((tuple(map(plain, r)) for r in found.select(*names).collect()), key=key)
    b = sorted((tuple(map(plain, r)) for r in wanted.fetchall()), key=key)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    found = library.entry(spark)
    assert found.columns == ["word", "best_match", "confidence", "n_candidates"]
    assert set(library.oracle_sql()) <= set(library.queries())
