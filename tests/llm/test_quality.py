"""op2: held-out accuracy, and the flat traversal against one tree at a time."""

import math
import zlib
from itertools import accumulate

import numpy as np
from mnemoframe.llm import quality as q
from pyspark.sql import functions as F


def test_held_out_accuracy(spark, middle):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{middle}/labels.parquet").collect()}
    rows = q.op2_quality(spark, middle).collect()
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert len(held) > 40 and sum(r.predicted == label[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_flat_arrays_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.1)).astype(float)
    m = q.grow(x, y, trees=30)

    def walk(row):
        total = m.base
        for k in m.roots:
            while m.left[k] != k:
                k = m.left[k] if row[m.feature[k]] <= m.edge[k] else m.right[k]
            total += m.value[k]
        return 1 / (1 + np.exp(-total))

    s = m.score(x)
    assert np.allclose(s[:200], [walk(r) for r in x[:200]]) and ((s > 0.5) == y).mean() > 0.95


def plain_trees(x, y):
    """The same trees grown one node after the other, every threshold of every statistic tried by loops over rows.

    Many cuts are equally good, so sums are added up in the same order: the first of the best cuts counts.
    """
    edges = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, q.BINS + 1)[1:-1]).tolist())) for f in range(x.shape[1])]
    code = [[sum(e < v for e in edges[f]) for f, v in enumerate(row)] for row in x.tolist()]
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    raw, trees = np.full(len(y), base), []

    def best_cut(rows, g, h):
        sums = []
        for f in range(x.shape[1]):
            gs, hs, ns = [0.0] * q.BINS, [0.0] * q.BINS, [0] * q.BINS
            for r in rows:
                b = code[r][f]
                gs[b], hs[b], ns[b] = gs[b] + g[r], hs[b] + h[r], ns[b] + 1
            sums.append([list(accumulate(v)) for v in (gs, hs, ns)])
        gt, ht = sums[0][0][-1], sums[0][1][-1]
        best = (1e-6, None)
        for f, (gl, hl, nl) in enumerate(sums):
            for b in range(len(edges[f])):
                if nl[b] >= q.LEAST_ROWS and len(rows) - nl[b] >= q.LEAST_ROWS:
                    gain = gl[b] * gl[b] / (hl[b] + q.L2) + (gt - gl[b]) * (gt - gl[b]) / (ht - hl[b] + q.L2) - gt * gt / (ht + q.L2)
                    if gain > best[0]:
                        best = (gain, (f, b, (gl[b], hl[b]), (gt - gl[b], ht - hl[b])))
        return best[1]

    def node(rows, g, h, depth, own):
        cut = best_cut(rows, g, h) if depth else None
        if cut is None:
            value = -q.RATE * own[0] / (own[1] + q.L2)
            for r in rows:
                raw[r] += value
            return value
        f, b, left, right = cut
        return f, edges[f][b], node([r for r in rows if code[r][f] <= b], g, h, depth - 1, left), node([r for r in rows if code[r][f] > b], g, h, depth - 1, right)

    for _ in range(12):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        trees.append(node(list(range(len(y))), g.tolist(), h.tolist(), q.DEPTH, (g.sum(), h.sum())))

    def score(row):
        total = base
        for t in trees:
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            total += t
        return 1 / (1 + math.exp(-min(max(total, -30), 30)))

    return score


def test_whole_query_equals_trees_grown_plainly(spark, small, monkeypatch):
    monkeypatch.setattr(q.grow, "__defaults__", (12, *q.grow.__defaults__[1:]))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet").where("quality is not null").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id")
    known = [(r.doc_id, float(r.quality)) for r in labels.collect() if r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 5]
    stats = {d: [float(np.float32(v)) for v in q.statistics(t)] for d, t in docs.items()}
    score = plain_trees(np.array([stats[d] for d, _ in known]), np.array([y for _, y in known]))
    got = {r.doc_id: r for r in q.op2_quality(spark, small).collect()}
    assert set(got) == set(docs) and len(known) > 20
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
        assert abs(r.score - score(stats[d])) < 1e-6, d


def test_edges(spark):
    assert len(q.statistics("a b\nc")) == len(q.FEATURES) and all(np.isfinite(q.statistics(t)).all() for t in (None, "", " ", "\n\n", "é" * 100_000, "x"))
    assert (q.grow(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))) == 0.5).all()
    assert (q.grow(np.zeros((5, 3)), np.ones(5)).score(np.zeros((2, 3))) > 0.99).all()
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "word " * 5, 1.0), (2, "b", None)], "doc_id long, text string, stats double")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1), (77, 1)], "doc_id long, quality int")
    stats = q.document_statistics(docs)
    assert q.score(stats, q.learn(stats, labels)).count() == 4
    more = labels.union(spark.createDataFrame([(2, 1)], "doc_id long, quality int")).withColumn("stats", F.lit("x")).withColumn("label", F.lit(5)).withColumn("text", F.lit(None))
    assert q.learn(stats, more).base == q.learn(stats, labels).base
    assert q.score(stats.limit(0), q.learn(stats, labels.limit(0))).count() == 0
