"""The driver's contract: every query with SQL gives the same rows as DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from lodestone.plans import oracle, queries


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return c


def flat(table):
    names = sorted(table.column_names)
    return names, sorted((tuple("-" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in row) for row in zip(*(table[n].to_pylist() for n in names))))


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_equals_sql(spark, con, sf, name):
    got = queries.QUERIES[name](spark, sf).toArrow()
    want = con.execute(oracle.SQL[name]).df()
    import pyarrow as pa

    assert flat(got) == flat(pa.Table.from_pandas(want, preserve_index=False).cast(pa.schema([(f.name, got.schema.field(f.name).type) for f in pa.Table.from_pandas(want, preserve_index=False).schema])))


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_keys():
    assert set(contract.oracle_sql()) <= set(contract.queries())
