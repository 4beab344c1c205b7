"""Every registered query of the library against its SQL counterpart, on the smallest tables."""

import pandas as pd
import pytest
from spark_cues.plans import registry

duckdb = pytest.importorskip("duckdb")
NAMES = sorted(registry.queries())
TABLES = "documents conversations events embeddings pages labels benchmark lineitem".split()


@pytest.fixture(scope="module")
def db(tiny):
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return out


def comparable(frame):
    def cell(v):
        if hasattr(v, "__iter__") and not isinstance(v, str):
            return str(list(v))
        if pd.isna(v):
            return ""
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else repr(float(v))
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, tiny, db, name):
    got = registry.queries()[name](spark, tiny).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = db.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)
