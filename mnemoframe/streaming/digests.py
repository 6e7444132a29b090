"""Digests at intervals (H7): a window that closes on a stream of mentions makes a digest and patterns of what fell in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from mnemoframe.operators.components import connected_components
from mnemoframe.scratch import written


def window_counts(mentions: DataFrame, window: str = "6 hours", watermark: str = "1 hour") -> DataFrame:
    """``window_start, entity, category, n`` of ``ts, entity, category``; on a stream, windows are given out once closed."""
    rows = mentions.select(F.col("ts").cast("timestamp").alias("ts"), F.col("entity").cast("string").alias("entity"), F.col("category").cast("string").alias("category"))
    if mentions.isStreaming:
        rows = rows.withWatermark("ts", watermark)
    counted = rows.groupBy(F.window("ts", window).alias("w"), "entity", "category").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "entity", "category", "n")


def digests(counts: DataFrame, top: int = 10) -> DataFrame:
    """A row for each window: ``n_mentions, categories`` (with counts), ``top_entities`` and a ``summary``."""
    cats = counts.where("category is not null").groupBy("window_start", "category").agg(F.sum("n").alias("n"))
    cats = cats.groupBy("window_start").agg(F.array_sort(F.collect_list(F.struct("category", "n"))).alias("categories"))
    best = counts.where("entity is not null").groupBy("window_start", "entity").agg(F.sum("n").alias("n"))
    first = W.partitionBy("window_start").orderBy(F.desc("n"), "entity")
    tops = best.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top).groupBy("window_start").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "entity"))), lambda x: x["entity"]).alias("top_entities"))
    out = counts.groupBy("window_start").agg(F.sum("n").alias("n_mentions")).join(cats, "window_start", "left").join(tops, "window_start", "left")
    return out.withColumn("summary", F.format_string("%d mentions. Top entities: %s.", F.col("n_mentions"), F.array_join("top_entities", ", ")))


def _edges(counts: DataFrame) -> DataFrame:
    """Entities and categories as nodes of a window's graph, one edge for each pair that stands together."""
    return counts.where("entity is not null and category is not null").select("window_start", F.concat(F.lit("e:"), "entity").alias("a"), F.concat(F.lit("c:"), "category").alias("b")).distinct()


def central(counts: DataFrame, k: int = 5, least: float = 0.1) -> DataFrame:
    """``window_start, id, degree, centrality`` of the ``k`` most central nodes of each window's graph above ``least``."""
    e = _edges(counts)
    both = e.select("window_start", F.col("a").alias("id")).unionAll(e.select("window_start", "b"))
    degree = both.groupBy("window_start", "id").agg(F.count(F.lit(1)).alias("degree"))
    nodes = degree.groupBy("window_start").agg(F.count(F.lit(1)).alias("nodes"))
    scored = degree.join(nodes, "window_start").withColumn("centrality", F.col("degree") / F.greatest(F.col("nodes") - 1, F.lit(1)))
    order = W.partitionBy("window_start").orderBy(F.desc("centrality"), "id")
    return scored.where(F.col("centrality") > least).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("window_start", "id", "degree", "centrality")


def clusters(counts: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """``window_start, component, size`` of the largest connected groups of each window's graph."""
    at = lambda c: F.concat(F.col("window_start").cast("string"), F.lit("|"), F.col(c))
    parts = connected_components(_edges(counts).select(at("a").alias("a"), at("b").alias("b")))
    sized = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    named = sized.select(F.substring_index("component", "|", 1).cast("timestamp").alias("window_start"), F.expr("substr(component, instr(component, '|') + 1)").alias("component"), "size")
    order = W.partitionBy("window_start").orderBy(F.desc("size"), "component")
    return named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


def digest_stream(mentions: DataFrame, root: str, window: str = "6 hours", watermark: str = "1 hour", top: int = 10, patterns: bool = True, every: str | None = None):
    """Starts a query that writes ``digests``, and with ``patterns`` ``central`` and ``clusters``, of each closed window.

    Every table below ``root`` has a folder for each batch, so one that is run again replaces itself. Rows later than the
    watermark allows change no digest. Without ``every`` all waiting input is read, then the query ends.
    """

    def close(batch: DataFrame, batch_id: int) -> None:
        counts = written(batch, "closed")
        if counts.isEmpty():
            return
        for name, f in (("digests", lambda c: digests(c, top)), *((("central", central), ("clusters", clusters)) if patterns else ())):
            f(counts).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")

    writer = window_counts(mentions, window, watermark).writeStream.outputMode("append").foreachBatch(close).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
