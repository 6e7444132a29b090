"""Relational queries over the memory tables.

A store is a mapping of tables: documents, chunks, nodes, edges, node_chunks, beliefs. Writes return new tables; nothing
is changed in place, so a failed job leaves the old version.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window as W, functions as F

from mnemoframe.scratch import tasks_for, written

Store = Mapping[str, DataFrame]


def current(beliefs: DataFrame, include_superseded: bool = False) -> DataFrame:
    """Beliefs that no later one supersedes, newest first; all of them if asked for."""
    kept = beliefs if include_superseded else beliefs.where(F.col("superseded_by").isNull())
    return kept.orderBy(F.desc("ts"), "id")


def entity_detail(store: Store, ids: DataFrame, most: int | None = None) -> DataFrame:
    """Nodes of ``ids.id`` with arrays of outgoing and incoming edges (with the other end's name) and current beliefs.

    ``most`` bounds each array to its first entries (edges by kind and name, beliefs from the oldest), for nodes with very
    many; the rest are then found by ``relationships`` and ``current``. Lists of text take far more memory than the rows
    that are shuffled, so rows are dealt to tasks by their number, four times as many as for plain rows.
    """
    edges = written(store["edges"].select("source", "target", "relationship"), "edges")
    now = written(store["beliefs"].where(F.col("superseded_by").isNull()).select("node_id", "ts", "id", "belief"), "beliefs")
    n = tasks_for(ids.sparkSession, 4 * max(edges.count(), now.count()))

    def first(df: DataFrame, by: str, *order: str) -> DataFrame:
        ranked = df.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(*order)))
        return df if most is None else ranked.where(F.col("r") <= most).drop("r")

    some = store["nodes"].join(ids.select("id").distinct(), "id", "left_semi").repartition(n, "id")
    names = store["nodes"].select(F.col("id").alias("other"), F.col("name").alias("other_name"))

    def side(mine: str, other: str, name: str) -> DataFrame:
        e = edges.join(ids.select(F.col("id").alias(mine)).distinct(), mine, "left_semi").join(names.withColumnRenamed("other", other), other).repartition(n, mine)
        return first(e, mine, "relationship", "other_name").groupBy(F.col(mine).alias("id")).agg(F.array_sort(F.collect_list(F.struct("relationship", "other_name"))).alias(name))

    held = now.join(ids.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi").repartition(n, "node_id")
    beliefs = first(held, "node_id", "ts", "id").groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ts", F.col("id").alias("belief_id"), "belief"))).alias("beliefs"))
    return some.join(side("source", "target", "outgoing"), "id", "left").join(side("target", "source", "incoming"), "id", "left").join(beliefs, "id", "left")


def search_entities(nodes: DataFrame, text: str = "", kind: str | None = None, sort_by: str = "mentions", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of nodes whose name contains ``text`` in any case, with the ``total`` of all pages."""
    hits = nodes.where(F.lower("name").contains(text.lower()))
    if kind is not None:
        hits = hits.where(F.col("type") == kind)
    order = {"mentions": F.desc("mention_count"), "name": F.asc("name"), "recent": F.desc("last_seen")}[sort_by]
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return hits.orderBy(order, "id").offset(offset).limit(limit).join(F.broadcast(total))


def update_entities(nodes: DataFrame, patch: DataFrame, now) -> DataFrame:
    """Nodes with names and types of ``patch(id, name, type)`` where those are not null; patched nodes are seen ``now``."""
    p = patch.select(F.col("id").alias("k"), F.struct("name", "type").alias("p"))
    rows = nodes.select(F.struct("*").alias("row"), F.col("id").alias("of")).join(p, F.col("of") == F.col("k"), "left")
    new = F.col("row").withField("name", F.coalesce("p.name", "row.name")).withField("type", F.coalesce("p.type", "row.type"))
    return rows.select(new.withField("last_seen", F.when(F.col("k").isNotNull(), now).otherwise(F.col("row.last_seen"))).alias("row")).select("row.*")


def delete_entities(store: Store, ids: DataFrame) -> dict[str, DataFrame]:
    """The store without the nodes ``ids.id``, their edges, beliefs and chunk links."""
    gone = ids.select("id").distinct()
    drop = lambda df, c: df.join(gone.withColumnRenamed("id", c), c, "left_anti")
    return dict(store) | {"nodes": drop(store["nodes"], "id"), "edges": drop(drop(store["edges"], "source"), "target"), "beliefs": drop(store["beliefs"], "node_id"), "node_chunks": drop(store["node_chunks"], "node_id")}


def merge_entities(store: Store, pairs: DataFrame) -> dict[str, DataFrame]:
    """Secondary nodes folded into primary ones (``pairs(primary, secondary)``; a primary is nobody's secondary).

    Edges, beliefs and chunk links are re-pointed, mention counts summed, first and last sights widened, self-edges
    dropped, and of parallel edges the one with the smallest id stays.
    """
    to = pairs.select(F.col("secondary").alias("old"), F.col("primary").alias("new")).distinct()

    def moved(df: DataFrame, c: str) -> DataFrame:
        rows = df.select(F.struct("*").alias("row"), F.col(c).alias("of")).join(to, F.col("of") == F.col("old"), "left")
        return rows.select(F.col("row").withField(c, F.coalesce("new", f"row.{c}")).alias("row")).select("row.*")

    n = store["nodes"].select("id", "type", "name", "first_seen", "last_seen", "mention_count").join(to, F.col("id") == F.col("old"), "left").withColumn("keep", F.coalesce("new", "id"))
    own = lambda c: F.max(F.when(F.col("id") == F.col("keep"), F.col(c))).alias(c)
    nodes = n.groupBy(F.col("keep")).agg(own("type"), own("name"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("mention_count").alias("mention_count")).withColumnRenamed("keep", "id")
    e = moved(moved(store["edges"], "source"), "target").where("source <> target")
    first = W.partitionBy("source", "target", "relationship").orderBy("id")
    edges = e.select(F.struct("*").alias("row"), F.row_number().over(first).alias("turn")).where("turn = 1").select("row.*")
    return dict(store) | {"nodes": nodes, "edges": edges, "beliefs": moved(store["beliefs"], "node_id"), "node_chunks": moved(store["node_chunks"], "node_id").distinct()}


def relationships(store: Store, entity: str | None = None, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Edges with the names of both ends, newest first; ``entity`` is an id at either end."""
    e = store["edges"]
    if entity is not None:
        e = e.where((F.col("source") == entity) | (F.col("target") == entity))
    if kind is not None:
        e = e.where(F.col("relationship") == kind)
    n = store["nodes"]
    named = e.join(n.select(F.col("id").alias("source"), F.col("name").alias("source_name")), "source").join(n.select(F.col("id").alias("target"), F.col("name").alias("target_name")), "target")
    return named.select("id", "source", "target", "relationship", "source_name", "target_name", "created_at").orderBy(F.desc("created_at"), "id").limit(limit)


def delete_rows(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id").distinct(), "id", "left_anti")


def add_beliefs(store: Store, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Beliefs with those of ``new`` whose node exists, and the rejected rows."""
    known = store["nodes"].select(F.col("id").alias("node_id")).distinct()
    return store["beliefs"].unionByName(new.join(known, "node_id", "left_semi"), allowMissingColumns=True), new.join(known, "node_id", "left_anti")


def supersede_beliefs(beliefs: DataFrame, new: DataFrame) -> DataFrame:
    """Adds ``new`` beliefs; the ones they name in ``replaces`` point at them. Of several, the smallest id is pointed at."""
    to = new.where(F.col("replaces").isNotNull()).groupBy(F.col("replaces").alias("k")).agg(F.min("id").alias("by"))
    rows = beliefs.select(F.struct("*").alias("row"), F.col("id").alias("of")).join(to, F.col("of") == F.col("k"), "left")
    old = rows.select(F.col("row").withField("superseded_by", F.coalesce("by", "row.superseded_by")).alias("row")).select("row.*")
    return old.unionByName(new.drop("replaces"), allowMissingColumns=True)


def search_memory(store: Store, pattern: str, modality: str | None = None, category: str | None = None, limit: int = 50) -> DataFrame:
    """Chunks whose content is like ``%pattern%`` in any case (``%`` and ``_`` are wildcards), newest documents first."""
    docs, chunks = store["documents"], store["chunks"]
    if modality is not None:
        docs = docs.where(F.col("modality") == modality)
    if category is not None:
        chunks = chunks.where(F.col("category") == category)
    hits = chunks.where(F.col("content").ilike(f"%{pattern}%")).join(docs.select("document_id", "filename", "modality", "ingested_at"), "document_id")
    return hits.select("chunk_id", "document_id", "filename", "modality", "category", "content", "ingested_at").orderBy(F.desc("ingested_at"), "chunk_id").limit(limit)


def document_entities(store: Store, ids: DataFrame) -> DataFrame:
    """``document_id, id, name, type, mention_count`` of nodes linked to chunks of ``ids.document_id``."""
    c = store["chunks"].join(ids.select("document_id").distinct(), "document_id", "left_semi").select("document_id", "chunk_id")
    return c.join(store["node_chunks"], "chunk_id").select("document_id", F.col("node_id").alias("id")).distinct().join(store["nodes"].select("id", "name", "type", "mention_count"), "id")


def entity_documents(store: Store, ids: DataFrame) -> DataFrame:
    """``id, document_id, filename, ingested_at`` of documents that mention the nodes ``ids.id``."""
    links = store["node_chunks"].join(ids.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi")
    found = links.join(store["chunks"].select("chunk_id", "document_id"), "chunk_id").select(F.col("node_id").alias("id"), "document_id").distinct()
    return found.join(store["documents"].select("document_id", "filename", "ingested_at"), "document_id")


def type_counts(table: DataFrame, kind: str) -> DataFrame:
    return table.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _timeline(store: Store, modality: str | None, category: str | None, search: str | None) -> DataFrame:
    d = store["documents"] if modality is None else store["documents"].where(F.col("modality") == modality)
    c = store["chunks"]
    if category is not None:
        c = c.where(F.col("category") == category)
    named = F.col("filename").ilike(f"%{search}%")
    if search is None:
        return d if category is None else d.join(c.select("document_id").distinct(), "document_id", "left_semi")
    hit = c.where(F.col("content").ilike(f"%{search}%")).select("document_id").distinct().withColumn("hit", F.lit(True))
    found = d.join(hit, "document_id", "left").where(F.col("hit") | named).drop("hit")
    return found if category is None else found.join(c.select("document_id").distinct(), "document_id", "left_semi")


def timeline(store: Store, modality: str | None = None, category: str | None = None, search: str | None = None, newest_first: bool = True, page: int = 1, page_size: int = 20) -> DataFrame:
    """A page of documents with the least summary and category of their chunks that fit; documents without chunks stay.

    The page is cut first, by documents alone; only its chunks are then aggregated, and texts are read only to be searched.
    """
    order = [F.desc("ingested_at") if newest_first else F.asc("ingested_at"), F.col("document_id")]
    some = _timeline(store, modality, category, search).select("document_id", "filename", "modality", "ingested_at").orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    c = store["chunks"]
    if category is not None:
        c = c.where(F.col("category") == category)
    if search is not None:
        fits = c.join(some.select("document_id", "filename"), "document_id").where(F.col("content").ilike(f"%{search}%") | F.col("filename").ilike(f"%{search}%"))
    else:
        fits = c.join(some.select("document_id"), "document_id", "left_semi")
    per = fits.groupBy("document_id").agg(F.min("summary").alias("summary"), F.min("category").alias("category"))
    return some.join(per, "document_id", "left").orderBy(*order)


def timeline_total(store: Store, modality: str | None = None, category: str | None = None, search: str | None = None) -> DataFrame:
    """One row ``total``: the documents that all pages of ``timeline`` have."""
    return _timeline(store, modality, category, search).agg(F.count_distinct("document_id").alias("total"))


def timeline_entities(store: Store, page: DataFrame) -> DataFrame:
    """``document_id, names``: the sorted distinct entity names of each document of a page."""
    return document_entities(store, page).groupBy("document_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def memory_stats(store: Store) -> DataFrame:
    """``measure, kind, n``: numbers of rows, and of documents, chunks and nodes by modality, category and type."""
    out = None
    for name in ("documents", "chunks", "nodes", "edges"):
        one = store[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), F.lit("all").alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    for name, c in (("documents", "modality"), ("chunks", "category"), ("nodes", "type")):
        out = out.unionByName(store[name].where(F.col(c).isNotNull()).groupBy(F.col(c).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("measure"), "kind", "n"))
    return out


def memory_detail(store: Store, ids: DataFrame) -> DataFrame:
    """Documents of ``ids`` with their chunks in order, the last summary and category that are not empty, and all action items.

    ``action_items`` (where chunks have that column) are those of all chunks, one list behind the other.
    """
    full = lambda c: F.max_by(c, F.when((F.col(c).isNotNull()) & (F.col(c) != ""), F.col("chunk_index"))).alias(c)
    c = store["chunks"].join(ids.select("document_id").distinct(), "document_id", "left_semi")
    items = F.col("action_items") if "action_items" in c.columns else F.lit(None).cast("array<string>")
    listed = F.array_sort(F.collect_list(F.struct("chunk_index", items.alias("items"))))
    actions = F.flatten(F.transform(listed, lambda x: F.coalesce(x["items"], F.array().cast("array<string>"))))
    per = c.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("chunks"), full("summary"), full("category"), actions.alias("action_items"))
    d = store["documents"].join(ids.select("document_id").distinct(), "document_id", "left_semi")
    names = timeline_entities(store, ids)
    return d.join(per, "document_id", "left").join(names, "document_id", "left")


def graph_view(store: Store, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The most mentioned nodes and the edges among them."""
    nodes = store["nodes"].orderBy(F.desc("mention_count"), "id").limit(limit)
    ids = nodes.select("id")
    edges = store["edges"].join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, edges


def recent(log: DataFrame, limit: int = 50, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The newest rows of a log; also how a log is cut to its retention."""
    return log.orderBy(F.desc(ts), F.desc(tie)).limit(limit)


def store_summary(store: Store) -> DataFrame:
    n = lambda t: store[t].agg(F.count(F.lit(1)).alias(f"n_{t}"))
    return n("nodes").join(n("edges")).join(n("documents"))
