"""The memory tables that the registered queries use, derived from the order tables, and the same in SQL.

Orders are documents and their lines chunks; parts and suppliers are the entities that chunks mention; a supplier that
shipped a part is an edge, one for each return flag; events are beliefs on parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from mnemoframe.scratch import tasks_for


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, d: str, rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``, about as many as there are order lines, dealt out by ``keys``."""
    return rows.repartition(tasks_for(spark, read(spark, d, "lineitem").count()), *keys)


def lines(spark: SparkSession, d: str) -> DataFrame:
    """One row for each order and line number; where numbers repeat, the least of every column.

    The least of strings is found by sorting, so rows are dealt out before, to tasks by their number.
    """
    return _dealt(spark, d, read(spark, d, "lineitem"), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.min("l_shipdate").alias("ts"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    uri = F.concat(F.col("o_orderpriority"), F.lit("/order"), F.col("o_orderkey").cast("string"), F.lit(".txt"))
    kind = F.when(F.col("o_orderstatus") == "O", "text").when(F.col("o_orderstatus") == "F", "pdf").otherwise("json")
    return o.select(F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("document_id"), uri.alias("filename"), kind.alias("modality"), uri.alias("source_uri"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("checksum"), F.col("o_orderdate").alias("ingested_at"), F.lit("processed").alias("status"))


def _part(c="part"):
    return F.concat(F.lit("p"), F.col(c).cast("string"))


def _supp(c="supp"):
    return F.concat(F.lit("s"), F.col(c).cast("string"))


def _chunk():
    return F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    p, s = read(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_name"), read(spark, d, "supplier").select(F.col("s_suppkey").alias("supp"), "s_name")
    text = F.concat(F.col("p_name"), F.lit(" from "), F.col("s_name"))
    return lines(spark, d).join(p, "part").join(s, "supp").select(_chunk().alias("chunk_id"), F.concat(F.lit("d"), F.col("l_orderkey").cast("string")).alias("document_id"), text.alias("content"), (F.col("l_linenumber") - 1).alias("chunk_index"), F.col("status").alias("summary"), F.col("flag").alias("category"))


def node_chunks(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d)
    return x.select(_part().alias("node_id"), _chunk().alias("chunk_id")).unionAll(x.select(_supp().alias("node_id"), _chunk().alias("chunk_id")))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d)
    p = read(spark, d, "part").select(_part("p_partkey").alias("id"), F.lit("PRODUCT").alias("type"), F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("name"))
    s = read(spark, d, "supplier").select(_supp("s_suppkey").alias("id"), F.lit("ORGANIZATION").alias("type"), F.col("s_name").alias("name"))
    seen = x.select(_part().alias("id"), "ts").unionAll(x.select(_supp().alias("id"), "ts")).groupBy("id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("mention_count"))
    return p.unionAll(s).join(seen, "id", "left").select("id", "type", "name", "first_seen", "last_seen", F.coalesce("mention_count", F.lit(0)).alias("mention_count"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    rel = F.concat(F.lit("supplies_"), F.col("flag"))
    e = lines(spark, d).select(_supp().alias("source"), _part().alias("target"), rel.alias("relationship"), "ts", _chunk().alias("chunk_id"))
    e = _dealt(spark, d, e, "source", "target", "relationship").groupBy("source", "target", "relationship").agg(F.min(F.struct("ts", "chunk_id")).alias("f"))
    return e.select(F.concat_ws(">", "source", "target", "relationship").alias("id"), "source", "target", "relationship", F.col("f.ts").alias("created_at"), F.col("f.chunk_id").alias("source_chunk"))


def beliefs(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    bid = F.concat(F.lit("b"), F.col("event_id").cast("string"))
    return read(spark, d, "events").select(bid.alias("id"), _part("user_id").alias("node_id"), F.col("event_type").alias("belief"), F.col("value").alias("confidence"), "ts", F.lead(bid).over(w).alias("superseded_by"))


def ways(spark: SparkSession, d: str) -> DataFrame:
    """A directed graph with inner nodes: customer to nation, nation to region, region to supplier."""
    c, n, r, s = (read(spark, d, t) for t in ("customer", "nation", "region", "supplier"))
    tag = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    e = c.select(tag("c", "c_custkey").alias("source"), tag("n", "c_nationkey").alias("target")).union(n.select(tag("n", "n_nationkey"), tag("r", "n_regionkey")))
    return e.union(r.join(n, n.n_regionkey == r.r_regionkey).join(s, s.s_nationkey == n.n_nationkey).select(tag("r", "r_regionkey"), tag("s", "s_suppkey"))).distinct()


def store(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {f.__name__: f(spark, d) for f in (documents, chunks, nodes, edges, node_chunks, beliefs)}


CTES = {
    "lines_": "select l_orderkey, l_linenumber, min(l_partkey) part, min(l_suppkey) supp, min(l_shipdate) ts, min(l_returnflag) flag, min(l_linestatus) status from lineitem group by 1, 2",
    "docs_": "select 'd' || o_orderkey as document_id, o_orderpriority || '/order' || o_orderkey || '.txt' as filename, case o_orderstatus when 'O' then 'text' when 'F' then 'pdf' else 'json' end as modality, o_orderpriority || '/order' || o_orderkey || '.txt' as source_uri, sha256(cast(o_custkey as varchar)) as checksum, o_orderdate as ingested_at, 'processed' as status from orders",
    "chunks_": "select l_orderkey || '-' || l_linenumber as chunk_id, 'd' || l_orderkey as document_id, p_name || ' from ' || s_name as content, l_linenumber - 1 as chunk_index, status as summary, flag as category from lines_ join part on part = p_partkey join supplier on supp = s_suppkey",
    "node_chunks_": "select 'p' || part as node_id, l_orderkey || '-' || l_linenumber as chunk_id from lines_ union all select 's' || supp, l_orderkey || '-' || l_linenumber from lines_",
    "seen_": "select id, min(ts) first_seen, max(ts) last_seen, count(*) mention_count from (select 'p' || part as id, ts from lines_ union all select 's' || supp, ts from lines_) group by 1",
    "nodes_": "select n.id, type, name, first_seen, last_seen, coalesce(mention_count, 0) as mention_count from (select 'p' || p_partkey as id, 'PRODUCT' as type, p_name || ' #' || p_partkey as name from part union all select 's' || s_suppkey, 'ORGANIZATION', s_name from supplier) n left join seen_ on n.id = seen_.id",
    "edges_": "select source || '>' || target || '>' || relationship as id, source, target, relationship, f.ts as created_at, f.c as source_chunk from (select 's' || supp as source, 'p' || part as target, 'supplies_' || flag as relationship, min(struct_pack(ts := ts, c := l_orderkey || '-' || l_linenumber)) f from lines_ group by 1, 2, 3)",
    "beliefs_": "select 'b' || event_id as id, 'p' || user_id as node_id, event_type as belief, value as confidence, ts, lead('b' || event_id) over (partition by user_id, event_type order by ts, event_id) as superseded_by from events",
    "arcs_": "select distinct 's' || supp as source, 'p' || part as target from lines_",
    "nb_": "select source as id, target as nb from arcs_ union select target, source from arcs_",
}


def sql(body: str) -> str:
    """``body`` with the tables it may name before it."""
    return "with recursive " + ", ".join(f"{k} as ({v})" for k, v in CTES.items()) + (", " + body.lstrip()[5:] if body.lstrip().startswith("with ") else " " + body)
