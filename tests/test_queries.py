"""Every registered query of the reference's operators gives the rows of its SQL on the smallest tables."""

import math

import duckdb
import pytest

from lodestone import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    r = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    want = sorted((tuple(_plain(dict(zip(names, x, strict=True))[c]) for c in cols) for x in r.fetchall()), key=repr)
    assert sorted(names) == cols
    assert sorted((tuple(_plain(x[c]) for c in cols) for x in df.collect()), key=repr) == want
