"""Graph analytics against loops over small graphs."""

import itertools
import math
import random

import pytest

from mnemoframe.operators import graph, ingest, insights, memory, retrieve
from mnemoframe.operators.components import connected_components


def make(spark, pairs, extra=()):
    ids = sorted({x for p in pairs for x in p} | set(extra))
    n = spark.createDataFrame([(i, f"N{i}", "T", 1) for i in ids], "id long, name string, type string, mention_count long")
    return n, spark.createDataFrame(list(pairs), "source long, target long")


def shortest(pairs, ids, s):
    out = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(a, set()).add(b)
    dist, paths, order = {s: 0}, {s: [[s]]}, [s]
    for x in order:
        for y in sorted(out.get(x, ())):
            if y not in dist:
                dist[y] = dist[x] + 1
                order.append(y)
            if dist[y] == dist[x] + 1:
                paths.setdefault(y, []).extend([*p, y] for p in paths[x])
    return paths


@pytest.mark.parametrize("seed", range(2))
def test_betweenness_counts_shortest_paths(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(9), rng.randrange(9)) for _ in range(16)}
    n, e = make(spark, pairs, range(9))
    want = dict.fromkeys(range(9), 0.0)
    for s in range(9):
        for t, paths in shortest(pairs, range(9), s).items():
            for p in paths:
                for v in p[1:-1]:
                    want[v] += 1 / len(paths)
    got = {r.id: r.betweenness for r in graph.betweenness(n, e).collect()}
    assert got == {k: pytest.approx(v / (8 * 7), abs=1e-6) for k, v in want.items()}


def test_pagerank_settles(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (4, 1), (1, 5)]
    n, e = make(spark, pairs, [6])
    rank = dict.fromkeys(range(1, 7), 1 / 6)
    out = {k: [b for a, b in pairs if a == k] for k in rank}
    for _ in range(200):
        lost = sum(rank[k] for k in rank if not out[k])
        rank = {k: 0.15 / 6 + 0.85 * (lost / 6 + sum(rank[a] / len(out[a]) for a, b in pairs if b == k)) for k in rank}
    got = {r.id: r["rank"] for r in graph.pagerank(n, e, tol=1e-9).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in rank.items()} and sum(got.values()) == pytest.approx(1)


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == label


def test_communities_are_connected(spark):
    two = [*itertools.combinations(range(5), 2), *itertools.combinations(range(10, 15), 2)]
    n, e = make(spark, two, [99])
    got = {r.id: r.community for r in graph.label_propagation(n, e).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10] and got[99] == 99
    assert [r["size"] for r in graph.communities(n, e).collect()] == [5, 5, 1]


def test_stats_hops_paths(spark):
    n, e = make(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (7, 8), (1, 2)])
    s = graph.graph_stats(n, e).first()
    assert (s.n_nodes, s.n_edges, s.components, s.largest, s.max_degree) == (6, 5, 2, 4, 3) and s.density == pytest.approx(5 / 30, abs=1e-6)
    seeds = spark.createDataFrame([(1,)], "id long")
    assert {(r.id, r.dist) for r in graph.khop(e, seeds, 2).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    pairs = spark.createDataFrame([(1, 4)], "source long, target long")
    assert sorted(r.path for r in graph.simple_paths(e, pairs).collect()) == [[1, 2, 3, 4], [1, 3, 4]]
    assert {r.component for r in graph.components(n, e).collect()} == {1, 7}
    assert graph.pagerank(n.limit(0), e.limit(0)).count() == 0 and graph.betweenness(n.limit(0), e.limit(0)).count() == 0


def test_graph_hops_scores_by_distance(spark):
    n, e = make(spark, [(1, 2), (2, 3), (3, 4)])
    chunks = spark.createDataFrame([(i, f"c{i}") for i in range(1, 5)], "node_id long, chunk_id string")
    q = spark.createDataFrame([(1, ["n1"])], "query_id int, entities array<string>")
    assert {(r.chunk_id, round(r.score, 6)) for r in retrieve.graph_hops(q, n, e, chunks, 2, 10).collect()} == {("c1", 1.0), ("c2", 0.5), ("c3", 0.333333)}
    both = spark.createDataFrame([(1, ["n1", "N4"])], "query_id int, entities array<string>")
    assert {r.chunk_id for r in retrieve.graph_hops(both, n, e, chunks, 0, 10).collect()} == {"c1", "c2", "c3", "c4"}


def test_diff_applied_to_old_gives_new(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, checksum string")
    new = spark.createDataFrame([("b", "9"), ("a", "1"), ("d", "4"), ("e", "3")], "path string, checksum string")
    d = {r.path: r.change for r in ingest.diff_snapshots(old, new).collect()}
    assert d == {"b": "modified", "c": "deleted", "d": "created", "e": "created"}
    m = {r.path: (r.change, r.old_path) for r in ingest.diff_snapshots(old, new, detect_moves=True).collect()}
    assert m == {"b": ("modified", None), "d": ("created", None), "e": ("moved", "c")}
    assert ingest.diff_snapshots(old.limit(0), new).count() == 0


def test_slots_retries_upserts(spark):
    e = spark.createDataFrame([(1, 0), (2, 1), (3, 200)], "event_id int, s int").selectExpr("event_id", "timestamp_seconds(s) ts")
    assert [r.slot_us // 1_000_000 for r in ingest.token_slots(e, 1).orderBy("event_id").collect()] == [0, 60, 200]
    a = spark.createDataFrame([(i,) for i in range(5)], "attempts int")
    assert [(r.action, r.delay_s) for r in ingest.retry_schedule(a).orderBy("attempts").collect()] == [("retry", 1), ("retry", 2), ("retry", 4), ("dead_letter", None), ("dead_letter", None)]
    old = spark.createDataFrame([("u", "1"), ("v", "2")], "source_uri string, checksum string")
    new, taken = ingest.upsert(old, spark.createDataFrame([("u", "1"), ("v", "3"), ("w", "2"), ("w", "2")], "source_uri string, checksum string"))
    assert sorted(map(tuple, new.collect())) == [("u", "1"), ("v", "3"), ("w", "2")] and taken.count() == 2


def test_fusion_values(spark):
    rows = [(1, "dense", "a", 1, 0.9, "xx"), (1, "sparse", "a", 2, 0.5, "longer"), (1, "sparse", "b", 1, 0.7, "y")]
    lists = spark.createDataFrame(rows, "query_id int, path string, chunk_id string, rank int, score double, snippet string")
    got = {r.chunk_id: r for r in retrieve.rrf(lists).collect()}
    assert got["a"].score == pytest.approx(1 / 61 + 1 / 62) and got["b"].score == pytest.approx(1 / 61) and got["a"].snippet == "longer" and got["a"]["rank"] == 1
    assert retrieve.rrf(lists.limit(0)).count() == 0 and retrieve.rrf(lists, top_k=1).count() == 1


def test_dense_blocks_and_edges(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(99, None), (50, [0.0, 0.0])], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "query_id int, embedding array<double>")
    whole = sorted(map(tuple, retrieve.dense_topk(q, v, 3).collect()))
    assert whole == sorted(map(tuple, retrieve.dense_topk(q, v, 3, block=2).collect())) and len(whole) == 15
    assert [r[1] for r in whole if r[0] == 0] == [0, 3, 6]
    assert retrieve.dense_topk(q.limit(0), v, 3).count() == 0 and retrieve.dense_topk(q, v.limit(0), 3).count() == 0


def test_insight_log_keeps_the_newest(spark):
    rows = spark.createDataFrame([(str(i), "k", "t", "d", "[]", i) for i in range(8)], "id string, type string, title string, description string, related_entities string, created_at int")
    kept = insights.add_insights(rows.where("created_at < 5"), rows.where("created_at >= 3"), keep=4)
    assert sorted(r.created_at for r in kept.collect()) == [4, 5, 6, 7]


def test_beliefs(spark):
    b = spark.createDataFrame([("1", "n", "x", None)], "id string, node_id string, belief string, superseded_by string")
    new = spark.createDataFrame([("2", "n", "y", None, "1")], "id string, node_id string, belief string, superseded_by string, replaces string")
    assert sorted((r.id, r.superseded_by) for r in memory.supersede_beliefs(b, new).collect()) == [("1", "2"), ("2", None)]


def test_contexts_and_confidence(spark):
    from mnemoframe.operators import answers

    rows = [(1, 1, "c1", "a/x.txt", "first " * 20, 0.05), (1, 2, "c2", None, "second", 0.05), (1, 3, "c3", "y.txt", None, 0.04), (2, 1, "c4", "z.txt", "only", 0.5)]
    ranked = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, file_name string, content string, score double")
    got = {r.query_id: r for r in answers.context(ranked, 150, "plain").collect()}
    assert got[1].n_used == 1 and got[1].context.startswith("[Source 1] (a/x.txt):\nfirst") and got[2].context == "[Source 1] (z.txt):\nonly\n"
    assert answers.context(ranked).where("query_id = 1").first().context.count("---") == 2
    said = spark.createDataFrame([(1, "APPROVE"), (2, "APPROVE"), (3, "APPROVE")], "query_id int, verdict string")
    for v in (1, 2):
        score = lambda word: {r.query_id: r.score for r in answers.confidence(ranked, said.replace("APPROVE", word), v).collect()}
        yes, maybe, no = score("APPROVE"), score("REVISE"), score("REJECT")
        assert yes[3] == 0.0 and no[2] < 0.5 * yes[2] and no[2] < maybe[2] < yes[2]
    factors = {r.query_id: r for r in answers.confidence_factors(ranked, said).collect()}
    assert factors[2].top_source == 1.0 and factors[3].top_source == 0.0 and factors[3].confidence in ("low", "medium") and factors[2].explanation.endswith(".")


def test_jaccard_shuffles_no_pairs(spark, shuffled):
    """600 nodes on 40 of 600 hubs each: nearly all pairs of nodes share hubs."""
    rng = random.Random(7)
    edges = [(f"s{i}", f"p{j}") for i in range(600) for j in rng.sample(range(600), 40)]
    e = spark.createDataFrame(edges, "source string, target string")
    seeds = spark.createDataFrame([(f"s{i}",) for i in range(600)], "id string")
    got = {}
    n = shuffled(lambda: got.update(((r.id, r["rank"]), (r.other, r.similarity)) for r in graph.jaccard_topk(e, seeds, 3).collect()))
    of = {}
    for s, p in edges:
        of.setdefault(s, set()).add(p)
    for s in ("s0", "s17", "s299"):
        near = sorted((-math.floor(10000 * len(of[s] & of[o]) / len(of[s] | of[o]) + 0.5) / 10000, o) for o in of if o != s)[:3]
        assert [got[s, i + 1] for i in range(3)] == [(o, -x) for x, o in near]
    print("shuffled", n)
    assert len(got) == 1800 and n < 12 * len(edges)


def test_substring_search_asks_neighbours_of_few_only(spark, shuffled):
    """Equal names, hubs, repeated links, and entities with too few chunks of their own."""
    rng = random.Random(8)
    nodes = [(f"n{i}", ["Anna Lee", "anna", "Bob the Builder", "builder", "Zo", "carl #1"][i % 6]) for i in range(120)]
    edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(4000)]
    links = [(f"n{i}", f"c{rng.randrange(400):03}") for i in range(120) for _ in range(0 if i % 6 in (3, 4) else 5)] + [("n4", "c007"), ("n4", "c007"), ("n3", "c399")]
    queries = [(q, [["ANNA LEE "], ["zo"], ["zo", "builder"], ["nobody", ""], ["bob the builders"], None][q % 6]) for q in range(300)]
    q = spark.createDataFrame(queries, "query_id long, entities array<string>")
    n = spark.createDataFrame(nodes, "id string, name string")
    e = spark.createDataFrame(edges, "source string, target string")
    c = spark.createDataFrame(links, "node_id string, chunk_id string")
    nb, of = {}, {}
    for a, b in edges:
        nb.setdefault(a, set()).add(b)
        nb.setdefault(b, set()).add(a)
    for a, b in links:
        of.setdefault(a, set()).add(b)
    want = []
    for i, asked in queries:
        score = {}
        for x in {x.strip().lower() for x in asked or () if x.strip()}:
            for a, name in nodes:
                if x in name.lower() or name.lower() in x:
                    score |= {k: 1.0 for k in of.get(a, ())}
                    for b in nb.get(a, ()):
                        score |= {k: max(0.5, score.get(k, 0)) for k in of.get(b, ())}
        want += [(i, k, r + 1, s) for r, (k, s) in enumerate(sorted(score.items(), key=lambda z: (-z[1], z[0]))[:5])]
    got = []
    rows = shuffled(lambda: got.extend(map(tuple, retrieve.graph_substring(q, n, e, c, 5).collect())))
    assert sorted(got) == sorted(want) and {r[3] for r in got} == {0.5, 1.0}
    print("shuffled", rows)
    assert rows < 40_000
