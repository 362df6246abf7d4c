"""Queries against their SQL on rows that the given tables have few of: ties, zeros below the digits, longer episodes."""

from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from framewright import plans
from framewright.plans.registry import QUERIES, SQL

plans.load()


def both(spark, folder, name, **tables):
    """The rows of the query and of its SQL as they are, signs of zeros included."""
    c = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        c.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, str(folder))
    names = sorted(df.columns)
    rel = c.sql(SQL[name])
    at = [rel.columns.index(n) for n in names]
    plain = lambda v: list(v) if isinstance(v, (list, tuple)) else v
    ours = Counter(repr([plain(v) for v in r]) for r in df.select(names).collect())
    return ours, Counter(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def embeddings(rows):
    return {"vec_id": list(range(len(rows))), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())}


def test_channel_stats_of_a_long_episode(spark, tmp_path):
    rows = [[float((37 * i + d) % 251) for d in range(64)] for i in range(700)]  # 136 of them are taken
    ours, theirs = both(spark, tmp_path, "a06_channel_stats", embeddings=embeddings(rows))
    assert ours == theirs and "136" in next(iter(ours))


def test_quantile10_where_three_digits_tie(spark, tmp_path):
    prices = [(500_000 + 1_875 * (2 * m + 1)) / 100 for m in range(2_500)]
    n = len(prices)
    day = pa.array([0] * n, pa.timestamp("us"))
    lines = {"l_orderkey": list(range(n)), "l_partkey": [1] * n, "l_suppkey": [1] * n, "l_linenumber": pa.array([1] * n, pa.int32()), "l_quantity": [7.0] * n, "l_extendedprice": prices, "l_discount": [0.04] * n, "l_tax": [0.03] * n, "l_shipdate": day}
    orders = {"o_orderkey": list(range(n)), "o_orderstatus": ["F"] * n, "o_orderpriority": ["1"] * n}
    ours, theirs = both(spark, tmp_path, "f01_normalized_quantile10", lineitem=lines, orders=orders)
    assert ours == theirs and ours.total() == n


def test_selected_dims_have_no_negative_zeros(spark, tmp_path):
    rows = [[(-1) ** d * 3e-7 for d in range(64)], [-0.0] * 64, [d / 128 for d in range(-32, 32)]]
    ours, theirs = both(spark, tmp_path, "f06_selected_dims", embeddings=embeddings(rows))
    assert ours == theirs and ours.total() == 3 and "-0.0," not in str(ours)


def test_rotations_where_six_digits_tie(spark, tmp_path):
    part = lambda k, d: (k * (2 * d + 3) % 61 - 30) / 29 + 0.013
    rows = [[(2 * k + 1 - 400) / 128] * 3 + [part(k + 1, d) for d in range(61)] for k in range(400)] + [[-3e-7, 2e-7, -1e-7] + [0.1 * (d + 1) for d in range(61)]]
    ours, theirs = both(spark, tmp_path, "f27_rotation_round_trip", embeddings=embeddings(rows))
    assert ours == theirs and ours.total() == 401


def test_split_labels_of_ninety_episodes(spark, tmp_path):
    n = 90
    events = {"event_id": list(range(n)), "ts": pa.array(list(range(n)), pa.timestamp("us")), "user_id": list(range(n)), "event_type": ["view"] * n, "value": [1.0] * n}
    ours, theirs = both(spark, tmp_path, "p14_split_labels", events=events)
    assert ours == theirs and sum("train" in r for r in ours) == 62
