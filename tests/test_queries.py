"""Every core query against its SQL on the driver's tables."""

from pathlib import Path

import duckdb
import pytest

from quire.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, float) and v != v:
        return None
    return int(v) if isinstance(v, (int, float)) and float(v).is_integer() else v


@pytest.mark.parametrize("name", REGISTRY)
def test_query(spark, name):
    query, sql = REGISTRY[name]
    got = query(spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    assert rows or name == "point_lookup"
    if sql:
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        result = db.execute(sql)
        at = {d[0]: i for i, d in enumerate(result.description)}
        assert sorted(at) == columns
        assert sorted(repr([plain(r[at[c]]) for c in columns]) for r in result.fetchall()) == rows
