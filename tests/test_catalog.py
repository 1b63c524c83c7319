"""Every catalog query runs, and gives the rows of its SQL."""

import glob
import math
import os

import duckdb
import pytest

from foliant.plans.catalog import CATALOG
from foliant.plans.sql import SQL


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, sf_dir, con, name):
    got = CATALOG[name](spark, sf_dir)
    rows = got.collect()
    if name in SQL:
        want = con.execute(SQL[name])
        names = sorted(d[0] for d in want.description)
        assert sorted(got.columns) == names
        order = [d[0] for d in want.description]
        expected = sorted([cell(r[order.index(c)]) for c in names] for r in want.fetchall())
        assert sorted([cell(r[c]) for c in names] for r in rows) == expected
    assert rows is not None
