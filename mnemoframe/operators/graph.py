"""Analytics over a directed graph of ``nodes(id, name, type, mention_count)`` and ``edges(source, target[, relationship])``.

One edge for each pair of ends counts; neighbours are successors and predecessors together. Loops write one table a
round in the shared folder, and the driver sees single aggregates only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from mnemoframe.operators.components import connected_components
from mnemoframe.scratch import discard, tasks_for, written

#: Neighbours that one list of a node has at most, about.
LISTED = 256


def simple(edges: DataFrame) -> DataFrame:
    """One row for each pair of ends."""
    return edges.select("source", "target").where(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """``id, nb``: both directions, without self-loops, once each."""
    ends = edges.select("source", "target").where("source <> target")
    pairs = written(ends.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")), "ends")
    once = pairs.repartition(tasks_for(edges.sparkSession, pairs.count()), "a", "b").distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("nb")), F.struct(F.col("b").alias("id"), F.col("a").alias("nb"))))
    return once.select(both.alias("both")).select("both.*")


def spread_join(left: DataFrame, right: DataFrame, on: str, most: int = 1000) -> DataFrame:
    """``left`` joined with ``right`` on one column; keys with more than ``most`` rows in ``left`` are dealt to several tasks.

    The hot keys are found once, and only their rows are dealt: each share of a key's rows in ``left`` meets a copy of its
    rows in ``right``. Without hot keys it is a plain join.
    """
    hot = written(left.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / most).alias("shares")).where("shares > 1"), "hot")
    if hot.isEmpty():
        return left.join(right, on)
    rows = left.join(hot, on).withColumn("share", F.pmod(F.xxhash64(*left.columns), F.col("shares"))).drop("shares")
    copies = right.join(hot, on).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    return left.join(hot, on, "left_anti").join(right, on).unionByName(rows.join(copies, [on, "share"]).drop("share"))


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree``: incoming and outgoing edges; a self-loop counts twice."""
    e = simple(edges)
    ends = e.select(F.col("source").alias("id")).unionAll(e.select(F.col("target").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def degree_centrality(nodes: DataFrame, edges: DataFrame, k: int | None = None) -> DataFrame:
    """``id, degree, centrality``: degree over nodes but one, 6 digits; the ``k`` largest if asked for."""
    n = nodes.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    d = nodes.select("id").distinct().join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    out = d.join(F.broadcast(n)).select("id", "degree", F.round(F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(F.lit(0.0)), 6).alias("centrality"))
    return out.orderBy(F.desc("centrality"), "id").limit(k) if k else out


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tol: float = 1e-6, rounds: int = 100) -> DataFrame:
    """``id, rank``; mass of nodes without successors is spread evenly. Stops when ranks move by less than ``n * tol``."""
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    out = simple(edges).groupBy("source").agg(F.count(F.lit(1)).alias("out"))
    links = written(simple(edges).join(out, "source"), "links")
    now = written(ids.join(out.withColumnRenamed("source", "id"), "id", "left").withColumn("rank", F.lit(1.0 / n)), "ranks")
    for _ in range(rounds):
        lost = now.where(F.col("out").isNull()).agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = links.join(now.select(F.col("id").alias("source"), "rank"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = now.join(given, "id", "left").select("id", "out", F.col("rank").alias("old"), ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank"))
        after = written(new, "ranks")
        moved = after.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        discard(now.sparkSession, now)
        now = after
        if tol and moved < n * tol:
            break
    return now.select("id", "rank")


def betweenness(nodes: DataFrame, edges: DataFrame, pivots: int = 100, k: int | None = None) -> DataFrame:
    """``id, betweenness``: shares of shortest directed paths from the first ``pivots`` ids, scaled to all sources.

    Breadth-first levels of all pivots at once count shortest paths; dependencies are then summed level by level back.
    """
    ids = nodes.select("id").distinct()
    n = ids.count()
    used = min(pivots, n)
    e = written(simple(edges).where("source <> target"), "arcs")
    seeds = ids.orderBy("id").limit(used)
    seen = written(seeds.select(F.col("id").alias("pivot"), "id", F.lit(0).alias("level"), F.lit(1.0).alias("paths")), "levels")
    level = 0
    while True:
        front = seen.where(F.col("level") == level).select("pivot", F.col("id").alias("source"), "paths")
        reached = front.join(e, "source").groupBy("pivot", F.col("target").alias("id")).agg(F.sum("paths").alias("paths"))
        new = written(reached.join(seen.select("pivot", "id"), ["pivot", "id"], "left_anti").select("pivot", "id", F.lit(level + 1).alias("level"), "paths"), "levels")
        if not new.limit(1).count():
            break
        seen, level = seen.unionByName(new), level + 1
    seen = written(seen, "levels")
    done = written(seen.where(F.col("level") == level).select("pivot", "id", "level", "paths", F.lit(0.0).alias("share")), "shares")
    total = done
    for at in range(level - 1, -1, -1):
        below = done.select("pivot", F.col("id").alias("target"), F.col("paths").alias("below"), F.col("share").alias("carried"))
        here = seen.where(F.col("level") == at)
        passed = here.select("pivot", F.col("id").alias("source"), "paths").join(e, "source").join(below, ["pivot", "target"])
        sums = passed.groupBy("pivot", F.col("source").alias("id")).agg(F.sum(F.col("paths") / F.col("below") * (1 + F.col("carried"))).alias("share"))
        done = written(here.join(sums, ["pivot", "id"], "left").select("pivot", "id", "level", "paths", F.coalesce("share", F.lit(0.0)).alias("share")), "shares")
        total = total.unionByName(done)
    scale = (n / used if used else 1.0) / max(1, (n - 1) * (n - 2))
    sums = total.where("id <> pivot").groupBy("id").agg(F.sum("share").alias("s"))
    out = ids.join(sums, "id", "left").select("id", F.round(F.coalesce("s", F.lit(0.0)) * scale, 6).alias("betweenness"))
    return out.orderBy(F.desc("betweenness"), "id").limit(k) if k else out


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``id, community``: each node takes the most frequent label around it, its own if that is among the most frequent.

    Ties go to the smallest label. Nodes move by turns, those with an even hash first, so that labels do not swing to and
    fro; after ``rounds`` labels stay as they are.
    """
    nb = written(neighbours(edges), "neighbours")
    now = written(nodes.select("id").distinct().withColumn("community", F.col("id")), "labels")
    for turn in range(2 * rounds):
        votes = nb.join(now.select(F.col("id").alias("nb"), "community"), "nb").groupBy("id", "community").agg(F.count(F.lit(1)).alias("n"))
        own = votes.join(now.select("id", F.col("community").alias("own")), "id")
        best = own.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), (F.col("community") != F.col("own")).alias("other"), "community")).alias("best"))
        moving = F.ascii(F.md5(F.col("id").cast("string"))) % 2 == turn % 2
        after = written(now.join(best, "id", "left").select("id", F.when(moving & F.col("best").isNotNull(), F.col("best.community")).otherwise(F.col("community")).alias("community"), F.col("community").alias("old")), "labels")
        moved = after.where("community <> old").limit(1).count()
        discard(now.sparkSession, now)
        now = after
        if turn % 2 and not moved:
            break
    discard(now.sparkSession, nb)
    return now.select("id", "community")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10, names: int = 50) -> DataFrame:
    """``community, size, members``: groups by size, the names of the ``names`` most mentioned members of each."""
    labelled = nodes.join(label_propagation(nodes, edges, rounds), "id")
    first = W.partitionBy("community").orderBy(F.desc("mention_count"), "id")
    sizes = labelled.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    named = labelled.withColumn("r", F.row_number().over(first)).where(F.col("r") <= names).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("members"))
    return sizes.join(named, "community").orderBy(F.desc("size"), "community")


def khop(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """``seed, id, dist``: nodes within ``depth`` undirected steps of each seed (column ``id``), the seed itself at 0."""
    return _reached(edges, seeds.select(F.col("id").alias("seed"), "id").distinct(), depth)


def _reached(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``start`` (``id``, and what is told apart by it) and the nodes within ``depth`` undirected steps, with ``dist``.

    A step is dealt to as many tasks as the pairs that it makes ask for, so that no task holds more of them than another
    size of the graph would give it.
    """
    keys = start.columns
    nb = written(neighbours(edges), "neighbours")
    degree, all_ = nb.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), nb.count()
    front = written(start.withColumn("dist", F.lit(0)), "hops")
    seen = front
    for step in range(1, depth + 1):
        pairs = front.select("id").join(degree, "id").agg(F.sum("degree")).first()[0]
        if not pairs:
            break
        n = tasks_for(edges.sparkSession, max(pairs, all_))
        next_ = front.select(*keys).repartition(n, "id").join(nb.repartition(n, "id"), "id").drop("id").withColumnRenamed("nb", "id").select(*keys)
        new = next_.repartition(n, *keys).distinct().join(seen.select(*keys).repartition(n, *keys), keys, "left_anti")
        front = written(new.withColumn("dist", F.lit(step)), "hops")
        seen = seen.unionByName(front)
    return seen


def subgraph(nodes: DataFrame, edges: DataFrame, names: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (with ``dist`` and ``is_seed``) and induced edges around all named seeds; unknown names are ignored."""
    seeds = lookup(nodes, names).select("id")
    near = written(_reached(edges, seeds.distinct(), depth), "near")  # which seed is near is not asked
    some = nodes.join(near, "id").withColumn("is_seed", F.col("dist") == 0)
    ends = near.select("id")
    kept = simple(edges).join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
    return some, kept.select("source", "target")


def simple_paths(edges: DataFrame, pairs: DataFrame, cutoff: int = 3) -> DataFrame:
    """``source, target, path``: directed paths without repeated nodes of at most ``cutoff`` edges, for each asked pair."""
    e = simple(edges).where("source <> target").select(F.col("source").alias("last"), F.col("target").alias("next"))
    asked = pairs.select("source", "target").distinct()
    open_ = asked.select("source", "target", F.array("source").alias("path"), F.col("source").alias("last"))
    found = None
    for left in range(cutoff, 0, -1):
        # what ends here is joined on both ends, so the last step makes no paths that lead nowhere
        hits = open_.join(e.withColumnRenamed("next", "target"), ["last", "target"]).where(~F.array_contains("path", F.col("target"))).select("source", "target", F.concat("path", F.array("target")).alias("path"))
        found = hits if found is None else found.unionByName(hits)
        if left > 1:
            step = open_.join(e, "last").where(~F.array_contains("path", F.col("next")) & (F.col("next") != F.col("target")))
            open_ = step.select("source", "target", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("last"))
    return found


def _nearest(pairs: pa.Table, k: int) -> pa.RecordBatch:
    """The ``k`` most similar others of each seed as ``seed, other, parts``, in ten thousandths; halves go up."""
    seed, other, own, size, both = (pairs[c].to_numpy() for c in ("seed", "other", "own", "size", "both"))
    every = own + size - both
    parts = (20000 * both + every) // (2 * every)
    order = np.lexsort((other, -parts, seed))
    order = order[(other != seed)[order] & (parts > 0)[order]]
    mine = seed[order]
    order = order[np.arange(len(mine)) - np.searchsorted(mine, mine) < k]
    return pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (seed, other, parts)], names=["seed", "other", "parts"])


def jaccard_topk(edges: DataFrame, seeds: DataFrame, k: int = 10) -> DataFrame:
    """``id, other, similarity, rank``: nodes that share most neighbours with each seed; above 0 only, 4 digits.

    Nodes are numbered in the order of their ids. Each neighbour of a seed sends it the numbers of its own neighbours, in
    lists of about ``LISTED``; the task of the seed adds them up, so pairs are not shuffled and but one seed is held at a
    time. The seeds that a hub has are dealt out, so a hub with many neighbours is not the work of one task.
    """
    nb = written(neighbours(edges), "neighbours")
    numbered = written(nb.groupBy("id").agg(F.count(F.lit(1)).alias("size")).orderBy("id").withColumn("number", F.monotonically_increasing_id()), "numbered")
    coded = nb.join(numbered, "id")
    cuts = numbered.select(F.col("id").alias("nb"), F.ceil(F.col("size") / LISTED).alias("cuts"))
    listed = coded.join(cuts, "nb").groupBy("nb", F.pmod(F.xxhash64("number"), "cuts").alias("cut")).agg(F.collect_list(F.struct("number", "size")).alias("l"))
    lists = listed.select("nb", "l.number", "l.size")
    mine = coded.join(seeds.select("id").distinct(), "id", "left_semi").select(F.col("number").alias("seed"), F.col("size").alias("own"), "nb")

    def work(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            many = pc.list_value_length(batch.column(2)).to_numpy()
            seed, own = (np.repeat(batch.column(i).to_numpy(), many) for i in (0, 1))
            rows = pa.table({"seed": seed, "other": batch.column(2).flatten(), "own": own, "size": batch.column(3).flatten(), "both": np.ones(len(seed), np.int64)})
            rows = rows if held is None else pa.concat_tables([held, rows])
            held = rows.group_by(["seed", "other"], use_threads=False).aggregate([("own", "max"), ("size", "max"), ("both", "sum")]).rename_columns(rows.column_names)
            last = batch.column(0)[-1]  # its lists may go on in the next batch
            done, held = held.filter(pc.not_equal(held["seed"], last)), held.filter(pc.equal(held["seed"], last))
            if done.num_rows:
                yield _nearest(done, k)
        if held is not None:
            yield _nearest(held, k)

    sent = spread_join(mine, lists, "nb").select("seed", "own", "number", "size").repartition("seed").sortWithinPartitions("seed")
    best = sent.mapInArrow(work, "seed long, other long, parts long")
    named = lambda c, name: numbered.select(F.col("number").alias(c), F.col("id").alias(name))
    sim = best.join(named("seed", "id"), "seed").join(named("other", "other_id"), "other").select("id", F.col("other_id").alias("other"), (F.col("parts") / 10000).alias("similarity"))
    return sim.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "other")))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, components, largest component, mean and largest degree, counts of types and relations.

    ``node_types`` and ``relationship_types`` are arrays of (kind, n) in order of the kind; a missing kind is ``unknown``.
    """

    def kinds(df: DataFrame, c: str, name: str) -> DataFrame:
        kind = F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c in df.columns else F.lit("unknown")
        per = df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
        return per.agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias(name))

    n = nodes.select("id").distinct()
    pairs = n.select(F.col("id").alias("a"), F.col("id").alias("b")).unionByName(simple(edges).select(F.col("source").alias("a"), F.col("target").alias("b")))
    parts = connected_components(pairs).groupBy("component").agg(F.count(F.lit(1)).alias("size")).agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"))
    counts = n.agg(F.count(F.lit(1)).alias("n_nodes")).join(simple(edges).agg(F.count(F.lit(1)).alias("n_edges")))
    deg = degrees(edges).agg(F.max("degree").alias("max_degree"))
    density = F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0)
    mean = F.when(F.col("n_nodes") > 0, 2 * F.col("n_edges") / F.col("n_nodes")).otherwise(0.0)
    types = kinds(nodes.dropDuplicates(["id"]), "type", "node_types").join(kinds(edges, "relationship", "relationship_types"))
    return counts.join(parts).join(deg).join(types).select("n_nodes", "n_edges", F.round(density, 6).alias("density"), "components", "largest", F.round(mean, 6).alias("avg_degree"), F.coalesce("max_degree", F.lit(0)).alias("max_degree"), "node_types", "relationship_types")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` for all nodes, those without edges included; a component is named by its smallest id."""
    loops = nodes.select(F.col("id").alias("a"), F.col("id").alias("b"))
    return connected_components(loops.unionByName(simple(edges).select(F.col("source").alias("a"), F.col("target").alias("b")))).withColumnRenamed("node", "id")


def lookup(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes whose trimmed lower-case name is asked for in ``names.name``."""
    asked = names.select(F.lower(F.trim("name")).alias("lname")).distinct()
    return nodes.withColumn("lname", F.lower(F.trim("name"))).join(asked, "lname", "left_semi").drop("lname")


def cooccurring(node_chunks: DataFrame, chunks: DataFrame, k: int = 20) -> DataFrame:
    """``a, b, n_documents``: the ``k`` pairs of nodes that share most documents."""
    of = node_chunks.join(chunks.select("chunk_id", "document_id"), "chunk_id").select("node_id", "document_id").distinct()
    pairs = spread_join(of.withColumnRenamed("node_id", "a"), of.withColumnRenamed("node_id", "b"), "document_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_documents")).orderBy(F.desc("n_documents"), "a", "b").limit(k)
