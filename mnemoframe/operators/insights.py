"""Insights over the graph and the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mnemoframe.operators.graph import components, degree_centrality, neighbours
from mnemoframe.operators.memory import recent
from mnemoframe.scratch import tasks_for, written


def connections(new: DataFrame, nodes: DataFrame, edges: DataFrame, names: int = 5) -> DataFrame:
    """For entities ``new.id`` with two or more neighbours: their number, some names, and a sentence."""
    nb = written(neighbours(edges).join(new.select("id").distinct(), "id", "left_semi"), "neighbours")
    # of the names of a repeated node one counts
    said = nodes.select(F.col("id").alias("nb"), F.col("name").alias("nb_name")).distinct().withColumn("counts", F.row_number().over(W.partitionBy("nb").orderBy("nb_name")) == 1)
    named = nb.join(said, "nb").repartition(tasks_for(nb.sparkSession, nb.count()), "id")
    # in the order of names a task passes through an entity's neighbours, and only the first names are gathered
    ranked = named.withColumn("r", F.dense_rank().over(W.partitionBy("id").orderBy(F.asc_nulls_last("nb_name"))))
    first = F.array_sort(F.collect_set(F.when(F.col("r") <= names, F.col("nb_name")))).alias("names")
    per = ranked.groupBy("id").agg(F.count_if("counts").alias("n"), first).where("n >= 2")
    named = per.join(nodes.select("id", "name"), "id")
    return named.select("id", "n", "names", F.concat(F.lit("New connections for "), F.col("name")).alias("title"), F.concat(F.col("name"), F.lit(" is connected to "), F.col("n").cast("string"), F.lit(" entities: "), F.array_join("names", ", ")).alias("description"))


def contradiction_candidates(chunks: DataFrame, node_chunks: DataFrame, beliefs: DataFrame, k: int = 10) -> DataFrame:
    """``chunk_id, belief_id, content, belief``: new chunks beside the ``k`` newest beliefs on entities they mention."""
    newest = W.partitionBy("chunk_id").orderBy(F.desc("ts"), "belief_id")
    pairs = chunks.select("chunk_id", "content").join(node_chunks, "chunk_id").join(beliefs.where("superseded_by is null").select("node_id", F.col("id").alias("belief_id"), "belief", "ts"), "node_id")
    return pairs.select("chunk_id", "belief_id", "content", "belief", "ts").distinct().withColumn("r", F.row_number().over(newest)).where(F.col("r") <= k).select("chunk_id", "belief_id", "content", "belief")


def belief_changes(beliefs: DataFrame) -> DataFrame:
    """Beliefs that differ from the one before them on the same entity."""
    w = W.partitionBy("node_id").orderBy("ts", "id")
    return beliefs.withColumn("before", F.lag("belief").over(w)).where("before is not null and before <> belief").select("node_id", "id", "ts", "before", "belief")


def digest(documents: DataFrame, chunks: DataFrame, nodes: DataFrame, top: int = 10) -> DataFrame:
    """One row: processed documents, categories with counts, the most mentioned entities, and a plain summary."""
    docs = documents.agg(F.count_if(F.col("status") == "processed").alias("n_documents"))
    cats = chunks.where("category is not null").groupBy("category").agg(F.count_distinct("document_id").alias("n")).agg(F.array_sort(F.collect_list(F.struct("category", "n"))).alias("categories"))
    first = nodes.orderBy(F.desc("mention_count"), "id").limit(top).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("mention_count")).alias("m"), "id", "name"))), lambda x: x["name"]).alias("top_entities"))
    return docs.join(cats).join(first).withColumn("summary", F.format_string("%d documents processed. Top entities: %s.", F.col("n_documents"), F.array_join("top_entities", ", ")))


def central_pattern(nodes: DataFrame, edges: DataFrame, k: int = 5, least: float = 0.1) -> DataFrame:
    return degree_centrality(nodes, edges, k).where(F.col("centrality") > least)


def cluster_pattern(nodes: DataFrame, edges: DataFrame, least: int = 3, clusters: int = 5, names: int = 5) -> DataFrame:
    """``component, size, names`` of the largest connected groups."""
    of = components(nodes, edges).join(nodes.select("id", "name"), "id")
    first = W.partitionBy("component").orderBy("id")
    sized = of.withColumn("r", F.row_number().over(first)).groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= names, F.struct("r", "name")))), lambda x: x["name"]).alias("names"))
    return sized.where(F.col("size") >= least).orderBy(F.desc("size"), "component").limit(clusters)


def insight_rows(found: DataFrame, kind: str, now: Column, title: str = "title", description: str = "description", names: str = "names") -> DataFrame:
    """Records for the insight log with name-based ids."""
    return found.select(F.sha2(F.concat_ws("|", F.lit(kind), F.col(title), F.col(description)), 256).alias("id"), F.lit(kind).alias("type"), F.col(title).alias("title"), F.col(description).alias("description"), F.to_json(names).alias("related_entities"), now.alias("created_at"))


def add_insights(log: DataFrame, new: DataFrame, keep: int = 500) -> DataFrame:
    """The log with new records, cut to the newest ``keep``; a record that is there already is not added again."""
    fresh = new.join(log.select("id"), "id", "left_anti")
    return recent(log.unionByName(fresh), keep, "created_at", "id")


def topic_counts(df: DataFrame, topic: str, document: str, ts: str = "ts", window: str = "7 days") -> DataFrame:
    """``window_start, topic, n, n_documents`` for each window and topic."""
    w = F.window(F.col(ts).cast("timestamp"), window)
    return df.groupBy(w.alias("w"), F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(document).alias("n_documents")).select(F.col("w.start").alias("window_start"), "topic", "n", "n_documents")
