"""Every query with SQL against DuckDB on the smallest tables: columns, types and values."""

import duckdb
import pytest

from panelyard import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields} == kinds
    place = [want.columns.index(c) for c in columns]
    got = in_order(tuple(r[c] for c in columns) for r in df.collect())
    assert got == in_order(tuple(r[i] for i in place) for r in want.fetchall())


MODELS = ("seed_ensemble_fit", "isotonic_calibration", "sigmoid_calibration", "feature_importance", "hazard_model", "stream_late_data")


@pytest.mark.parametrize("name", MODELS)
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
