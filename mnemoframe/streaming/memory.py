"""A memory that micro-batches keep up to date (H6, C9): a new version of a document withdraws what the old one gave.

Below a root folder every table has a folder for each batch, which a batch that is run again replaces. ``log`` names the
documents that a batch changed and is written last, so a batch without its log is not there yet. Rows of chunks, mentions
and relations belong to the version of their document; those of an older version are left out by the log. Nodes and edges
are derived: a batch makes anew those that a withdrawn or a new row touches, and no others, and of each the newest row
counts. So a batch reads the rows of the names it touches, not the texts that were read before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from mnemoframe.functions.extract import cooccurrences
from mnemoframe.operators.ingest import build_edges, build_nodes
from mnemoframe.scratch import exists

TABLES = {
    "log": "source_uri string, document_id string, checksum string, ts timestamp, live boolean",
    "chunks": "chunk_id string, document_id string, content string, chunk_index int, total_chunks int, source_uri string",
    "mentions": "chunk_id string, pos int, name string, type string, ts timestamp, source_uri string",
    "relations": "chunk_id string, source string, target string, relationship string, ts timestamp, source_uri string",
    "nodes": "id string, name string, type string, mention_count long, first_seen timestamp, last_seen timestamp",
    "edges": "id string, source string, target string, relationship string, source_chunk string, created_at timestamp",
}


def read_table(spark: SparkSession, root: str, table: str, before: int | None = None) -> DataFrame:
    """A table with its ``batch``; no rows before the first batch. ``before`` leaves out that batch and later ones."""
    schema = f"{TABLES[table]}, batch long"
    path = f"{root}/{table}"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before)


def live_documents(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """``source_uri, document_id, checksum, ts, batch``: the newest version of every document that was not deleted."""
    last = F.max_by(F.struct("document_id", "checksum", "ts", "live"), "batch").alias("v")
    return read_table(spark, root, "log", before).groupBy("source_uri").agg(last, F.max("batch").alias("batch")).where("v.live").select("source_uri", "v.document_id", "v.checksum", "v.ts", "batch")


def _current(rows: DataFrame, live: DataFrame) -> DataFrame:
    return rows.join(live.select("source_uri", "batch"), ["source_uri", "batch"], "left_semi")


def _changed(batch: DataFrame, live: DataFrame) -> DataFrame:
    """What a batch changes: of several rows of a document the newest, and only if it differs from what is known."""
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
    rows = batch.where(F.col("source_uri").isNotNull()).select("document_id", "source_uri", "checksum", F.col("ts").cast("timestamp").alias("ts"), "text", gone.alias("gone"))
    last = rows.groupBy("source_uri").agg(F.max(F.struct("ts", "checksum", "gone", "document_id", "text")).alias("d")).select("source_uri", "d.*")
    both = last.join(live.select("source_uri", F.col("checksum").alias("was"), F.col("batch").alias("since")), "source_uri", "left")
    return both.where(F.when(F.col("gone"), F.col("since").isNotNull()).otherwise(F.col("since").isNull() | ~F.col("checksum").eqNullSafe(F.col("was"))))


def _names(mentions: DataFrame) -> DataFrame:
    return mentions.select(F.lower(F.trim("name")).alias("lname")).distinct()


def _ends(relations: DataFrame) -> DataFrame:
    key = lambda c: F.lower(F.trim(c))
    return relations.select(key("source").alias("a"), key("target").alias("b"), "relationship").distinct()


def memory_batch(root: str, cut: Callable[[DataFrame], DataFrame], mentions: Callable[[DataFrame], DataFrame], mentions_only: bool = False, refresh: Callable[[DataFrame, DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], DataFrame]:
    """A handler for ``ingest_stream``: new versions of documents are cut, their entities extracted and related.

    Batches have ``document_id, source_uri, checksum, ts, text`` and may have ``deleted``. A document whose checksum is known
    is skipped, a changed or deleted one has all its rows withdrawn, a deletion of an unknown one is ignored; rows without
    a source_uri are left out. A document_id belongs to one source_uri. ``cut`` makes ``chunk_rows`` of documents, ``mentions`` makes ``chunk_id, pos, name, type`` of
    chunks. ``refresh`` gets the new chunks, the ids of withdrawn ones and the batch, for an index that is kept beside.
    """

    def handle(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        read = lambda table: spark.read.schema(TABLES[table]).parquet(f"{root}/{table}/batch={batch_id}")

        def put(df: DataFrame, table: str) -> DataFrame:
            names = [f.split()[0] for f in TABLES[table].split(", ")]
            df.select(names).write.mode("overwrite").parquet(f"{root}/{table}/batch={batch_id}")
            return read(table)

        before = live_documents(spark, root, batch_id)
        path = f"{root}/changed/batch={batch_id}"
        _changed(batch, before).write.mode("overwrite").parquet(path)
        changed = spark.read.parquet(path)
        docs = changed.where("not gone")
        of = docs.select("document_id", "source_uri", "ts")
        chunks = put(cut(docs).join(of.select("document_id", "source_uri"), "document_id"), "chunks")
        found = mentions(chunks)
        told = put(found.join(chunks.select("chunk_id", "source_uri"), "chunk_id").join(of.select("source_uri", "ts"), "source_uri"), "mentions")
        pairs = cooccurrences(told.select("chunk_id", "pos", "name", "type"))
        related = put(pairs.join(chunks.select("chunk_id", "source_uri"), "chunk_id").join(of.select("source_uri", "ts"), "source_uri"), "relations")

        # rows of versions that end here, and of those that go on
        ended = changed.where("since is not null").select("source_uri", F.col("since").alias("batch"))
        stay = before.join(changed.select("source_uri"), "source_uri", "left_anti")
        olds = {t: read_table(spark, root, t, batch_id) for t in ("chunks", "mentions", "relations")}
        lost = {t: _current(olds[t], ended) for t in olds}
        mine = lambda t, new: _current(olds[t], stay).drop("batch").unionByName(new)
        names = _names(lost["mentions"]).union(_names(told)).distinct()
        key = lambda c: F.lower(F.trim(c))
        m = mine("mentions", told).withColumn("lname", key("name")).join(names, "lname", "left_semi").drop("lname")
        r = mine("relations", related)
        ends = r.select(key("source").alias("lname"), F.col("source").alias("name")).union(r.select(key("target"), "target")).join(names, "lname", "left_semi")
        nodes = build_nodes(m, ends.select(F.col("name").alias("source"), F.lit(None).cast("string").alias("target")), mentions_only)
        every = names.select(F.sha2("lname", 256).alias("id")).join(nodes, "id", "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(0)))
        put(every, "nodes")
        touched = _ends(lost["relations"]).union(_ends(related)).distinct()
        left = r.withColumn("a", key("source")).withColumn("b", key("target")).join(touched, ["a", "b", "relationship"], "left_semi")
        edges = build_edges(left).select("id", "source_chunk", "created_at")
        named = touched.select(F.sha2("a", 256).alias("source"), F.sha2("b", 256).alias("target"), "relationship")
        put(named.withColumn("id", F.sha2(F.concat_ws("|", "source", "target", "relationship"), 256)).join(edges, "id", "left"), "edges")
        if refresh is not None:
            refresh(chunks, lost["chunks"].select("chunk_id"), batch_id)
        put(changed.withColumn("live", ~F.col("gone")), "log")
        per = chunks.groupBy("source_uri").agg(F.count(F.lit(1)).alias("n_chunks"))
        out = changed.select("document_id", "source_uri", "checksum", "ts", "gone").join(per, "source_uri", "left")
        return out.withColumn("error", F.when(F.col("n_chunks").isNull() & ~F.col("gone"), "no chunk"))

    return handle


def read_memory(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, nodes and edges as the finished batches left them."""
    done = read_table(spark, root, "log").select("batch").distinct()

    def newest(table: str, there) -> DataFrame:
        rows = read_table(spark, root, table).join(F.broadcast(done), "batch", "left_semi")
        last = rows.withColumn("turn", F.row_number().over(W.partitionBy("id").orderBy(F.desc("batch"))))
        return last.where((F.col("turn") == 1) & there).drop("turn", "batch")

    chunks = _current(read_table(spark, root, "chunks"), live_documents(spark, root)).drop("batch")
    return chunks, newest("nodes", F.col("mention_count") > 0), newest("edges", F.col("created_at").isNotNull() | F.col("source_chunk").isNotNull())


def compact(spark: SparkSession, root: str, to: str) -> None:
    """Writes what counts of a memory below a new root, as one batch with the number of the last; the old one stays."""
    log = read_table(spark, root, "log")
    last = log.agg(F.max("batch")).first()[0]
    if last is None:
        return
    live = live_documents(spark, root)
    chunks, nodes, edges = read_memory(spark, root)
    rows = {"chunks": chunks, "nodes": nodes, "edges": edges} | {t: _current(read_table(spark, root, t), live).drop("batch") for t in ("mentions", "relations")}
    for table, df in (rows | {"log": live.withColumn("live", F.lit(True)).drop("batch")}).items():
        names = [f.split()[0] for f in TABLES[table].split(", ")]
        df.select(names).write.mode("overwrite").parquet(f"{to}/{table}/batch={last}")
