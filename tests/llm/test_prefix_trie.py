"""The trie of conversations against dictionaries of prefixes, and its queries against SQL."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from mnemoframe.llm import prefix_trie as x

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, depth string, least int"


def direct(found):
    """Nodes of ``{conv_id: [(role, text), ...]}``."""
    members, ends = {}, {}
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in members:
        children.setdefault(p[:-1], set()).add(p) if p else None
    for p, c in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
            saved[p[:d]] = saved.get(p[:d], 0) + ((len(c) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted((min(c), len(p), min(members[p[:-1]]) if p else -1, len(c), len(children.get(p, ())), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, c in members.items())


def rebuild(found):
    out = {}
    for c, turns in found.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = found.get(c - c % 5, [])[:h] + turns[h:]
    return out


def nodes(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(COLUMNS).collect())


def conversations(seed, n=160):
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant"]), rng.choice(["", "a", "é", "yes", f"t{rng.randrange(3)}"]))
    pool = [[turn() for _ in range(rng.choice([1, 2, 5, 30]))] for _ in range(6)]
    out = {}
    for c in range(n):
        base = rng.choice(pool)
        out[c] = base[: rng.randrange(1, len(base) + 1)] + [turn() for _ in range(rng.choice([0, 0, 1, 3]))]
    return out


def rows(found):
    return [(c, t, role, text, "x", 1) for c, turns in found.items() for t, (role, text) in enumerate(turns)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_dictionaries(spark, seed, monkeypatch):
    monkeypatch.setattr(x, "BLOCK_ROWS", [1, 5, 1 << 16][seed])
    monkeypatch.setattr(x, "PIECE", [3, 1 << 20, 40][seed])
    found = conversations(seed)
    sequences = x.sequences(spark.createDataFrame(rows(found), TURNS).repartition(4))
    trie, members = x.build(sequences)
    assert nodes(trie) == direct(found)
    ranks = {r.conv_id: r.rank for r in members.collect()}
    assert sorted(ranks) == sorted(found)
    for r in trie.collect():
        inside = [c for c, k in ranks.items() if r.first_rank <= k <= r.last_rank]
        assert (len(inside), min(inside)) == (r.n_convs, r.conv_id)
    assert nodes(x.build(x.rebuilt(sequences))[0]) == direct(rebuild(found))


def test_one_long_and_one_repeated_conversation(spark):
    found = {c: [("user", "the same")] * 2 for c in range(300)} | {1000: [("user", "the same")] * 150}
    assert nodes(x.build(x.sequences(spark.createDataFrame(rows(found), TURNS)))[0]) == direct(found)


def test_nulls_ties_and_repeats(spark):
    data = [(1, None, "user", "first"), (1, 0, None, None), (1, 2, "user", "b"), (1, 1, "user", "a"), (2, None, "user", "first"), (2, 5, "", ""), (None, 0, "user", "of none")]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], TURNS)
    want = {1: [("user", "first"), ("", ""), ("user", "a"), ("user", "b")], 2: [("user", "first"), ("", "")]}
    assert nodes(x.build(x.sequences(df))[0]) == direct(want)
    tied = [(7, 0, "user", "p"), (7, 0, "user", "q"), (7, 0, "user", "q"), (8, 0, "user", "q"), (8, 0, "user", "p"), (8, 0, "user", "q")]
    same = nodes(x.build(x.sequences(spark.createDataFrame([(*r, "x", 1) for r in tied], TURNS)))[0])
    assert [(r[1], r[3]) for r in same] == [(0, 2), (1, 2), (2, 2), (3, 2)]
    assert x.build(x.sequences(df.limit(0)))[0].count() == 0
    turnless = x.build(x.rebuilt(x.sequences(spark.createDataFrame([(4, 0, "u", "t", "x", 1)], TURNS))))[0]
    assert nodes(turnless) == direct(rebuild({4: [("u", "t")]}))


def test_query_equals_its_sql(spark, middle):
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{middle}/conversations.parquet'")
    want = c.execute(x.OP11_SQL).fetchdf()[COLUMNS].astype({"parent_conv_id": "Int64"}).fillna({"parent_conv_id": -1})
    assert nodes(x.op11_prefix_trie(spark, middle)) == sorted(map(tuple, want.values.tolist()))


def test_query_has_the_columns_of_its_sql(spark, small):
    assert x.op11_prefix_trie(spark, small).columns == COLUMNS


def test_searches():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 6, 300)
    levels = x._sparse(values)
    at, depth = rng.integers(0, 300, 400), rng.integers(0, 7, 400)
    right, left = x._right(levels, at, depth), x._left(levels, at, depth)
    for a, d, r, lo in zip(at.tolist(), depth.tolist(), right.tolist(), left.tolist(), strict=True):
        end, begin = a, a
        while end + 1 < 300 and values[end + 1] >= d:
            end += 1
        while begin > 0 and values[begin] >= d:
            begin -= 1
        assert (end, begin) == (r, lo)
    lo = np.minimum(at, 299 - 5)
    assert (x._least(levels, lo, lo + 5) == [values[i : i + 6].min() for i in lo]).all()
