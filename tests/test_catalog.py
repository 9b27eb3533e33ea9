"""Every query of the catalog against its SQL on the small tables."""

from pathlib import Path

import duckdb
import pytest

from veilmark.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    rows = catalog.QUERIES[name](spark, str(DATA)).collect()
    if name not in catalog.ORACLES:
        return
    rel = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in rel.description]
    expected = sorted((tuple(map(plain, r)) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr) == expected
