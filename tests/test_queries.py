"""Every registered engine query with SQL equals it on the smallest tables; the others run."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from recallweave.plans import assist, oracles, queries

ORACLES, QUERIES = oracles.ORACLES | assist.ORACLES, queries.QUERIES | assist.QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages conversations".split()


def canonical(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 6))  # a negative zero differs
    if isinstance(v, (list, tuple)):
        return str([canonical(x) for x in v])
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = Counter(tuple(canonical(v) for v in r) for r in df.select(*cols).collect())
    if name not in ORACLES:
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert rows == Counter(tuple(canonical(r[i]) for i in order) for r in found.fetchall())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stream_gives_every_burst(spark, sf):
    got = QUERIES["stream_debounce"](spark, f"/root/testdata/{sf}").select("start_ms", "end_ms", "changes", F.size("paths").cast("long")).collect()
    want = QUERIES["debounce_sessions"](spark, f"/root/testdata/{sf}").select("start_ms", "end_ms", "changes", "paths").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
