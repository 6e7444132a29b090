"""Connected components as alternating star contraction on DataFrames (F10 and the near-duplicate operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mnemoframe.scratch import discard, drop_shuffles, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.unionByName(least.select("a", F.col("m").alias("b")))


def _sketch(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for every node of an undirected edge list; ``component`` is its smallest node.

    Each round is two joins on node keys and one written table; the driver sees a count and a checksum. The number of
    edges never grows, and rounds are logarithmic in the longest path. Null ends and self-loops: a self-loop keeps its
    node, an edge with a null end is ignored. An empty list gives no rows.
    """
    raw = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    loops = raw.where(F.col("a") == F.col("b")).select(F.col("a").alias("node")).distinct()
    now = written(raw.where(F.col("a") != F.col("b")).distinct(), "edges")
    before = None
    for turn in range(0 if now.isEmpty() else max_rounds):
        step = _small_star(_large_star(now).distinct()).where(F.col("a") != F.col("b")).distinct()
        after = written(step, "edges")
        sketch = _sketch(after)
        discard(now.sparkSession, now)
        now = after
        if turn % 4 == 3:
            drop_shuffles(now.sparkSession)
        if sketch == before:
            break
        before = sketch
    else:
        if before is not None:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    named = stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    alone = loops.join(named, "node", "left_anti").select("node", F.col("node").alias("component"))
    return named.unionByName(alone)
