"""Ranked search against scores of all documents, and the quadtree against a plain grid."""

import math
import random
import re

import numpy as np
import pytest
from mnemoframe.llm import lexical as x

DOCS = "doc_id long, text string, item_id string, score string, query int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def direct(docs, items, k):
    found = [(d, terms(t)) for d, t in docs]
    found = [(d, w) for d, w in found if w]
    n_all, length = len(found), sum(len(w) for _, w in found)
    df = {}
    for _, w in found:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for d, w in found:
            m = 75 + 25 * len(w) * n_all // length
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 12 * m)) for t in terms(text) if t in df)
            if score > 0:
                scored.append((-score, math.inf if d is None else d))
        out += [(item, r + 1, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_scores_of_all_documents(spark, seed, monkeypatch):
    monkeypatch.setattr(x, "SHARD_DOCUMENTS", [7, 65536, 30][seed])
    monkeypatch.setattr(x, "BATCH", [3, 1024, 1][seed])
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "ÀB", "àb", f"w{rng.randrange(60)}", f"{rng.randrange(40)}"])
    docs = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 40, 300])))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " -- "), (None, "the w1 w2"), (5, docs[5][1]), (203, docs[7][1]), (204, "w3," * 9000), (205, "z" * 700_000 + "-w5")]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(25)] + [(90, None), (91, "never seen"), (92, "!"), (None, "w1 w1 w2"), (3, "the the")]
    d = spark.createDataFrame([(a, b, "x", "y", 1) for a, b in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(a, b, 4) for a, b in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in x.rank(d, q, 5, block_bytes=[200, 10**6, 900][seed]).collect()]
    key = lambda r: (str(r[0]), r[1], str(r[2]), r[3])
    assert sorted(got, key=key) == sorted(direct(docs, items, 5), key=key)


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert x.rank(d, q.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert x.rank(d.limit(0), q).count() == x.rank(d, q.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in x.rank(d, q).collect()] == [(1, 1, 1)]


def test_grid():
    rng = np.random.default_rng(1)
    for n_rows, n_columns in ((1, 1), (5, 300), (200, 9)):
        grid = rng.integers(1, 1000, (n_rows, n_columns)) * (rng.random((n_rows, n_columns)) < 0.2)
        r, c = np.nonzero(grid)
        treap = x.Treap(r, c, grid[r, c], n_rows, n_columns)
        asked, weights = rng.choice(n_rows, min(4, n_rows), replace=False), rng.integers(0, 50, min(4, n_rows))
        want = weights @ grid[asked]
        best = sorted((-s, i) for i, s in enumerate(want) if s > 0)[:10]
        columns, scores = treap.search(asked, weights, 10, np.arange(n_columns))
        assert [(-s, i) for s, i in zip(scores.tolist(), columns.tolist(), strict=True)] == best
        # nodes hold the maxima of what is below them
        assert not len(r) or int(treap.most[0][0]) == grid.max()


def test_query_equals_its_sql(spark, middle):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{middle}/{t}.parquet'")
    assert sorted(map(tuple, x.op13_lexical(spark, middle).collect())) == sorted(c.execute(x.OP13_SQL).fetchall())
