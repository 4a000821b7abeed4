"""Every registered query of the sweep operators against its SQL in DuckDB, on the smallest tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from cosmotab.plans.queries import SQL, Q  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, f"{v:.5e}" if isinstance(v, float) else str(v)) for v in r))


def test_every_query_has_sql():
    assert set(Q) == set(SQL)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", list(Q))
def test_query_equals_sql(spark, duck, name):
    df = Q[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = ordered([tuple(r[c] for c in columns) for r in df.collect()])
    found = duck.execute(SQL[name])
    there = [x[0] for x in found.description]
    assert sorted(there) == columns
    want = ordered([tuple(r[there.index(c)] for c in columns) for r in found.fetchall()])
    assert len(got) == len(want)
    off = [(a, b) for a, b in zip(got, want, strict=True) if not all(map(close, a, b))]
    assert not off, off[:3]
