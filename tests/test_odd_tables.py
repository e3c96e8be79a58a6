"""Registered queries against their DuckDB equivalents on tables with large ids and short or long vectors."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparkbits.plans import registry

from .test_queries import plain

IDS = [*range(3), 1919, 1920, 2047, 2048, 2049, 3000, 4095, 4096, 4097, 6990, 6991, 16384, 65407, 65408, 65535, 65536, 102563, 1048575, 1048576, 2097151]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("odd")
    vectors = [[rng.uniform(-1, 1) for _ in range(64)] for _ in IDS]
    pq.write_table(pa.table({"vec_id": pa.array(IDS, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    events = [(u, rng.uniform(0, 70)) for u in (1, 2, 3, 5, 8, 20, 38, 39, 40, 41, 42, 64, 999, 1000, 1001, 1300) for _ in range(u)]
    pq.write_table(pa.table({"event_id": pa.array(range(len(events)), pa.int64()), "user_id": pa.array([u for u, _ in events], pa.int64()), "value": [v for _, v in events]}), folder / "events.parquet")
    return folder


def same(spark, folder, name):
    import duckdb

    duck = duckdb.connect()
    for f in folder.glob("*.parquet"):
        duck.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(plain, r)) for r in duck.sql(registry.oracle_sql()[name]).select(*columns).fetchall())


@pytest.mark.parametrize("name", ["int_to_bits", "count_sub", "rows_scatter", "uleb128", "utf8_code_point"])
def test_odd(spark, odd, name):
    same(spark, odd, name)


@pytest.mark.parametrize("name", ["contingency", "distances"])
def test_all_vectors_meet(spark, odd, name):
    pairs = registry.queries()[name](spark, str(odd)).select("a_id", "b_id").collect()
    assert sorted(map(tuple, pairs)) == sorted((a, b) for a in IDS for b in IDS if a != b)
    same(spark, odd, name)
