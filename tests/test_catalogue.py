"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tesserae.plans import registered

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registered.QUERIES))
def test_query(spark, duck, name):
    df = registered.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    ours = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    got = duck.execute(registered.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    # A double array where the SQL has floats would be another value.
    floats = {c for c, t in df.dtypes if t == "array<float>"}
    assert floats == {d[0] for d in got.description if str(d[1]).upper() == "FLOAT[]"}
    at = [names.index(c) for c in cols]
    assert ours == Counter(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())
