"""Every registered query with SQL gives the same rows in DuckDB; the others give rows."""

import datetime
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LLM = tuple(f"op{n}_" for n in range(1, 14)) + ("pipeline",)
NAMES = [n for n in entry.queries() if not n.startswith(LLM)]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "quantize"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], Counter(tuple(plain(r[k]) for k in order) for r in data)


@pytest.fixture(scope="module")
def duck(middle):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{middle}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, middle, name):
    df = entry.queries()[name](spark, middle)
    got = rows(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert sum(got[1].values()) > 0
        return
    done = duck.execute(sql)
    want = rows([c[0] for c in done.description], done.fetchall())
    assert got[0] == want[0]
    assert sum(got[1].values()) == sum(want[1].values())
    extra, missing = list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3]
    assert not extra and not missing, f"only in Spark: {extra}; only in SQL: {missing}"


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "rank", "score"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
