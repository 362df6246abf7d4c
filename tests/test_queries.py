"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from framewright import plans
from framewright.plans.registry import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
plans.load()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(v) for v in r) for r in df.select([f"`{c}`" for c in columns]).collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() >= 0 and df.columns


def test_streams_deduplicate_like_a_loop(spark):
    rows = QUERIES["r05_observation_deduplication"](spark, SF).collect()
    from framewright.plans.views import frames_ev

    kept, want = {}, set()
    for f in frames_ev(spark, SF).orderBy("episode_index", "frame_index").collect():
        last, x = kept.get(f.episode_index, (-1, None))
        if f.label == "error" or (f.frame_index > last and (x is None or abs(f.x - x) >= 20.0)):
            kept[f.episode_index] = (f.frame_index, f.x)
            want.add((f.episode_index, f.frame_index, f.x))
    assert {tuple(r) for r in rows} == want
