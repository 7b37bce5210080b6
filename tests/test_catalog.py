"""Every query against its SQL, on whole small tables."""

import decimal

import duckdb
import pytest

from civicframe.plans import catalog, catalog_casework, catalog_dockets, catalog_more, catalog_review, catalog_stores, statistics  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {**catalog.QUERIES, **statistics.QUERIES}
ORACLES = {**catalog.ORACLES, **statistics.ORACLES}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else v


#: Queries whose result may well be empty on the smallest tables.
MAY_BE_EMPTY: set[str] = set()
#: Queries that select what has one verdict.
MAY_BE_ALIKE: set[str] = {"SRCH10_envelope"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted(str([plain(r[cols.index(k)]) for k in order]) for r in cur.fetchall())
    assert sorted(str([plain(r[k]) for k in order]) for r in got) == want
    assert want or name in MAY_BE_EMPTY
    told = [k for k in order if k in ("score", "sensitive", "tags", "snippet", "action", "reason", "verdict", "matched")]
    if len(got) > 50 and name not in MAY_BE_ALIKE:  # a verdict that is the same for all rows proves nothing
        assert all(len({str(r[k]) for r in got}) > 1 for k in told), told
