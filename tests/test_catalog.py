import datetime

import duckdb
import pytest

from spanveil.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    if name in catalog.ORACLES:
        want = sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name]})").fetchall(), key=repr)
        assert len(got) == len(want)
        assert got == want, next((a, b) for a, b in zip(got, want) if a != b)
    if name not in ("obfuscated_term_find", "custom_matcher_find"):
        assert got
