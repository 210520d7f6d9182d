import decimal
import math
from pathlib import Path

import duckdb
import pytest
from ledgerline.plans import catalog

SF = "/root/testdata/sf0.001"


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, (float, decimal.Decimal)):
            return None if math.isnan(v) else round(float(v), 6)
        return float(v) if isinstance(v, int) and not isinstance(v, bool) else str(v) if v is not None else None

    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    c = duck.execute(catalog.SQL[name])
    assert got == canon([x[0] for x in c.description], c.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
