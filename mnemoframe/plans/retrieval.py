"""Retrieval, fusion, answers and evaluation (D, E22) with their SQL.

Queries are the benchmark items; chunks are documents; the vector of a document or item is the one with its id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.operators import answers, approximate, chunking, retrieve
from mnemoframe.operators.kept_index import KeptIndex
from mnemoframe.plans.store import read, sql as graph_sql, store, ways
from mnemoframe.scratch import exists, new_path
from mnemoframe.sources import files

CATALOG: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        CATALOG[name] = (f, sql)
        return f

    return add


# ---- dense -------------------------------------------------------------------------------------------------------------


def _nearest(queries: str, vectors: str, k: int, extra: str = "") -> str:
    return f"select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 6) desc, chunk_id) as rank, score from (select q.query_id, v.vec_id as chunk_id, list_cosine_similarity(q.e, v.embedding::double[]) as score from ({queries}) q, ({vectors}) v) {extra} qualify rank <= {k}"


_HUNDREDTHS = "select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 100 = 0"


def _hundredths(spark, d):
    return read(spark, d, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def _out(df):
    return df.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("d01_dense_topk", f"select query_id, chunk_id, rank, round(score, 6) score from ({_nearest(_HUNDREDTHS, 'select * from embeddings', 10, 'where score >= 0.1')})")
def d01(spark, d):
    return _out(retrieve.dense_topk(_hundredths(spark, d), read(spark, d, "embeddings"), 10, min_score=0.1))


@query("d01_approximate")
def d01b(spark, d):
    """The same queries by hash tables; tests measure how much of the exact answer they find."""
    return _out(approximate.dense_topk_approximate(_hundredths(spark, d), read(spark, d, "embeddings"), 10))


@query("d02_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def d02(spark, d):
    v = read(spark, d, "embeddings")
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(retrieve.cosine("embedding", "other"), 6).alias("cosine"))


@query("d03_dense_filtered", f"select query_id, chunk_id, rank, round(score, 6) score from ({_nearest(_HUNDREDTHS, 'select * from embeddings where label = 3', 5)})")
def d03(spark, d):
    return _out(retrieve.dense_topk(_hundredths(spark, d), read(spark, d, "embeddings"), 5, filters={"label": 3}))


@query("d04_scroll", "select vec_id, label from embeddings where vec_id > 99 and label <> 3 order by vec_id limit 50")
def d04(spark, d):
    return retrieve.scroll(read(spark, d, "embeddings").where("label <> 3"), after=99, limit=50).select("vec_id", "label")


@query("d05_delete_vectors", "select label, count(*) n from embeddings where vec_id not in (select doc_id from documents where lang = 'en') group by 1")
def d05(spark, d):
    gone = read(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return retrieve.delete_vectors(read(spark, d, "embeddings"), gone).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- sparse ------------------------------------------------------------------------------------------------------------

_TOK = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"
_WORD = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2)"


def _bm25(tok: str = _TOK, docs: str = "documents", tail: str = "_") -> str:
    t = tail
    return f"""len{t} as (select doc_id, len({tok}) n from {docs}), stat{t} as (select count(*) n, avg(n) avg_len from len{t}), post{t} as (select doc_id, term, count(*) tf from (select doc_id, unnest({tok}) term from {docs}) group by 1, 2),
 raw{t} as (select term, df, ln(n - df + 0.5e0) - ln(df + 0.5e0) raw from (select term, count(*) df from post{t} group by 1) cross join stat{t}), mean{t} as (select avg(raw) mean from raw{t}), idf{t} as (select term, df, case when raw < 0 then 0.25e0 * mean else raw end idf from raw{t} cross join mean{t}),
 ask{t} as (select item_id, term, count(*) qtf from (select item_id, unnest({tok}) term from benchmark) group by 1, 2),
 score{t} as (select item_id as query_id, p.doc_id as chunk_id, sum(qtf * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * l.n / s.avg_len))) score from ask{t} a join idf{t} i using (term) join post{t} p using (term) join len{t} l on l.doc_id = p.doc_id cross join stat{t} s group by 1, 2),
 top{t} as (select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 6) desc, chunk_id) as rank, score from score{t} where round(score, 9) > 0 qualify rank <= 10)"""


def _chunks(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def _items(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _dealt(docs):
    """A table of few parts is dealt out, a large one stays where it is read."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


#: Indexes of this process by session, data and kind of words.
_KEPT: dict[tuple, KeptIndex] = {}


def _index(spark, d, words=False):
    """The index of all documents, made by the first query that asks and kept for the others of the session."""
    key = (spark.sparkContext.applicationId, d, words)
    if key not in _KEPT or not exists(spark, _KEPT[key].root):
        _KEPT[key] = KeptIndex(spark, new_path(spark, "index"), words, "long")
        _KEPT[key].change(_dealt(_chunks(spark, d)))
    return _KEPT[key]


def _sparse(spark, d, words=False, **more):
    return _index(spark, d, words).search(_items(spark, d), 10, **more)


@query("d06_bm25_index", f"with {_bm25()} select term, df, round(idf, 6) idf from idf_")
def d06(spark, d):
    return _index(spark, d).tables()[1].select("term", "df", F.round("idf", 6).alias("idf"))


_AFTER = "after_ as (select doc_id, case when doc_id % 3 = 0 then reverse(text) || ' reversed' else text end as text from documents where doc_id % 5 <> 1)"


@query("d06_changed_index", f"with {_AFTER}, {_bm25(docs='after_')} select query_id, chunk_id, rank, round(score, 6) score from top_")
def d06b(spark, d):
    """Searched after three changes: half of the documents, then all, a third of them in place of others, then some are removed."""
    docs = _dealt(_chunks(spark, d))
    index = KeptIndex(spark, new_path(spark, "index"), id_type="long")
    index.change(docs.where("chunk_id % 2 = 0"))
    index.change(docs.where("chunk_id % 2 = 1 or chunk_id % 3 = 0").withColumn("content", F.when(F.col("chunk_id") % 3 == 0, F.concat(F.reverse("content"), F.lit(" reversed"))).otherwise(F.col("content"))))
    index.change(docs.limit(0), docs.where("chunk_id % 5 = 1").select("chunk_id"))
    return _out(index.search(_items(spark, d), 10))


@query("d07_bm25_topk", f"with {_bm25()} select query_id, chunk_id, rank, round(score, 6) score from top_")
def d07(spark, d):
    return _out(_sparse(spark, d))


@query("d08_bm25_squash", f"with {_bm25(_WORD)} select query_id, chunk_id, rank, round(least(1, score / (score + 5)), 6) score from (select query_id, chunk_id, score, row_number() over (partition by query_id order by round(least(1, score / (score + 5)), 6) desc, chunk_id) as rank from score_ qualify rank <= 10)")
def d08(spark, d):
    return _out(_sparse(spark, d, words=True, squash=True, keep_zero=True))


@query("d09_index_of_vectors", f"with {_bm25(docs='(select doc_id, text from documents join embeddings on vec_id = doc_id)')} select term, df, round(idf, 6) idf from idf_")
def d09(spark, d):
    have = read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id")).distinct()
    return retrieve.bm25_index(_chunks(spark, d).join(have, "chunk_id", "left_semi"))[1].select("term", "df", F.round("idf", 6).alias("idf"))


# ---- graph -------------------------------------------------------------------------------------------------------------


def _named(spark, d):
    s = read(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("about "), "s_name").alias("text"), F.array(F.upper("s_name")).alias("entities"))


@query("d10_graph_exact", graph_sql("select s_suppkey as query_id, chunk_id, row_number() over (partition by s_suppkey order by chunk_id) as rank, 1.0::double score from supplier join node_chunks_ on node_id = 's' || s_suppkey qualify rank <= 10"))
def d10(spark, d):
    s = store(spark, d)
    return _out(retrieve.graph_exact(_named(spark, d), s["nodes"], s["node_chunks"], 10))


@query("d11_graph_substring", graph_sql("with hit_ as (select s_suppkey q, n.id from supplier, nodes_ n where contains(lower(n.name), lower(s_name)) or contains(lower(s_name), lower(n.name))), sc_ as (select q, id, max(s) s from (select q, id, 1.0::double s from hit_ union all select q, nb, 0.5::double from hit_ join nb_ using (id)) group by 1, 2) select q as query_id, chunk_id, rank, s as score from (select q, chunk_id, max(s) s, row_number() over (partition by q order by max(s) desc, chunk_id) as rank from sc_ join node_chunks_ on node_id = id group by 1, 2) where rank <= 10"))
def d11(spark, d):
    s = store(spark, d)
    return _out(retrieve.graph_substring(_named(spark, d), s["nodes"], s["edges"], s["node_chunks"], 10))


_TWO = "with b_ as (select q.c, q.s, cn.n_nationkey cn, cn.n_regionkey cr, sn.n_regionkey sr from (select o_custkey c, min(l_suppkey) s from orders join lineitem on l_orderkey = o_orderkey group by 1) q join customer on c_custkey = q.c join supplier on s_suppkey = q.s join nation cn on cn.n_nationkey = c_nationkey join nation sn on sn.n_nationkey = s_nationkey), u_ as (select c q, 'c' || c id, 0 dist from b_ union all select c, 'n' || cn, 1 from b_ union all select c, 'r' || cr, 2 from b_ union all select c, 'c' || c_custkey, 2 from b_ join customer on c_nationkey = cn union all select c, 's' || s, 0 from b_ union all select c, 'r' || sr, 1 from b_ union all select c, 'n' || n_nationkey, 2 from b_ join nation on n_regionkey = sr union all select c, 's' || s_suppkey, 2 from b_ join nation on n_regionkey = sr join supplier on s_nationkey = n_nationkey)"


@query("d12_graph_hops", f"{_TWO}, v_ as (select q, id, 1e0 / (1 + min(dist)) as score from u_ group by 1, 2) select q as query_id, id as chunk_id, rank, round(score, 6) as score from (select *, row_number() over (partition by q order by round(score, 6) desc, id) as rank from v_) where rank <= 10")
def d12(spark, d):
    """What is within two steps of a customer and of the first supplier of its orders, or on ways over nation and region."""
    tag = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    nodes = c.select(tag("c", "c_custkey").alias("id"), F.col("c_name").alias("name")).unionAll(s.select(tag("s", "s_suppkey"), "s_name"))
    bought = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    named = bought.join(c, "c_custkey").join(s, "s_suppkey")
    asked = named.select(F.col("c_custkey").alias("query_id"), F.array(F.upper("c_name"), "s_name").alias("entities"))
    e = ways(spark, d)
    own = e.select(F.col("source").alias("node_id")).union(e.select("target")).distinct().withColumn("chunk_id", F.col("node_id"))
    return _out(retrieve.graph_hops(asked, nodes, e, own, 2, 10))


# ---- fusion ------------------------------------------------------------------------------------------------------------

_ITEM_VECTORS = "select item_id as query_id, embedding::double[] as e from benchmark join embeddings on vec_id = item_id"
_LISTS = f"dense_ as ({_nearest(_ITEM_VECTORS, 'select * from embeddings', 10)}), {_bm25()}, {_bm25(_WORD, tail='w')}, lists_ as (select query_id, 'dense' as path, chunk_id, rank, score from dense_ union all select query_id, 'sparse', chunk_id, rank, score from top_ union all select query_id, 'words', chunk_id, rank, score from topw)"


def _dense(spark, d):
    v = read(spark, d, "embeddings")
    return retrieve.dense_topk(_items(spark, d).join(v.withColumnRenamed("vec_id", "query_id"), "query_id").select("query_id", "embedding"), v, 10)


def _lists(spark, d):
    named = lambda df, p: df.select("query_id", F.lit(p).alias("path"), "chunk_id", "rank", "score")
    return named(_dense(spark, d), "dense").unionByName(named(_sparse(spark, d), "sparse")).unionByName(named(_sparse(spark, d, words=True), "words"))


def _fused(weight: str, top: int = 10) -> str:
    return f"fused_ as (select query_id, chunk_id, sum({weight} / (60 + rank)) rrf, string_agg(distinct path, ',' order by path) paths from lists_ group by 1, 2)"


_WEIGHT = "case path when 'dense' then 0.4e0 when 'sparse' then 0.3e0 else 0.3e0 end"


@query("d13_rrf", f"with {_LISTS}, {_fused(_WEIGHT)} select query_id, chunk_id, round(rrf, 6) score, paths from (select *, row_number() over (partition by query_id order by round(rrf, 9) desc, chunk_id) r from fused_) where r <= 10")
def d13(spark, d):
    x = retrieve.rrf(_lists(spark, d), weights={"dense": 0.4, "sparse": 0.3, "words": 0.3}, top_k=10)
    return x.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.array_join("paths", ",").alias("paths"))


@query("d14_rrf_neutral", f"with {_LISTS}, {_fused('1e0')} select query_id, chunk_id, round(0.8e0 * rrf + 0.2e0 * 0.5e0, 6) score from fused_")
def d14(spark, d):
    return retrieve.rrf(_lists(spark, d), recency_weight=0.2).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


_AGE = "select event_id doc, ts from events"


@query("d15_rrf_recency", f"with {_LISTS}, {_fused('1e0')} select query_id, chunk_id, rank, round(0.9e0 * rrf + 0.1e0 * fresh, 6) score from (select *, row_number() over (partition by query_id order by ts desc nulls last, round(0.9e0 * rrf + 0.1e0 * fresh, 9) desc, chunk_id) as rank from (select f.*, ts, coalesce(least(1, pow(0.5e0, floor((epoch(timestamp '2024-02-01') - epoch(ts)) / 86400) / 30e0)), 0.5e0) fresh from fused_ f left join events on event_id = chunk_id * 3)) where rank <= 10")
def d15(spark, d):
    ts = read(spark, d, "events").select((F.col("event_id") / 3).alias("k"), F.col("ts").alias("created_at"))
    now = F.lit("2024-02-01").cast("timestamp")
    dated = _lists(spark, d).join(ts, F.col("chunk_id").cast("double") == F.col("k"), "left").withColumn("recency", retrieve.recency("created_at", now))
    return _out(retrieve.rrf(dated, recency_weight=0.1, top_k=10, temporal=True))


@query("d16_weighted_fusion", f"with {_LISTS} select query_id, chunk_id, round(sum(case path when 'dense' then 0.75e0 when 'sparse' then 0.25e0 else 0.33e0 end * score), 6) score from lists_ group by 1, 2")
def d16(spark, d):
    return retrieve.weighted_fusion(_lists(spark, d), {"dense": 3, "sparse": 1}).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("d17_recency", "select event_id, round(case when event_id % 7 = 0 then 0.5 else least(1, greatest(0, pow(0.5e0, floor((epoch(timestamp '2024-01-05') - epoch(ts)) / 86400) / 30e0))) end, 6) recency from events")
def d17(spark, d):
    said = F.when(F.col("event_id") % 7 == 0, "not-a-date").otherwise(F.col("ts").cast("string"))
    return read(spark, d, "events").select("event_id", F.round(retrieve.recency(said, F.lit("2024-01-05").cast("timestamp")), 6).alias("recency"))


_NAMES = "[A-Z][a-z]{7,}"
_GRAPH = f"names_ as (select distinct doc_id, lower(x) as name from (select doc_id, unnest(regexp_extract_all(text, '{_NAMES}')) x from documents)), want_ as (select distinct item_id, w from (select item_id, unnest(list_concat(list_transform(regexp_extract_all(text, '{_NAMES}'), lambda x: lower(x)), list_filter({_TOK}, lambda x: length(x) > 3))) w from benchmark)), graph_ as (select item_id as query_id, doc_id as chunk_id, row_number() over (partition by item_id order by doc_id) as rank, 1.0::double score from (select distinct item_id, doc_id from want_ join names_ on name = w) qualify rank <= 5)"


def _graph(spark, d):
    """Documents that mention what an item names: long capitalised words are the nodes, as in ``extract_named``'s queries."""
    names = lambda c: F.regexp_extract_all(c, F.lit(_NAMES), F.lit(0))
    said = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.explode(names("text")).alias("name")).select("chunk_id", F.lower("name").alias("node_id")).distinct()
    nodes = said.select(F.col("node_id").alias("id"), F.col("node_id").alias("name")).distinct()
    return retrieve.graph_exact(_items(spark, d).withColumn("entities", names("text")), nodes, said, 5)


_HYBRID = f"with {_LISTS}, {_GRAPH}, all_ as (select query_id, 'dense' as path, chunk_id, rank from dense_ union all select query_id, 'sparse', chunk_id, rank from top_ union all select query_id, 'graph', chunk_id, rank from graph_)"


@query("d18_hybrid", f"{_HYBRID}, h_ as (select query_id, cast(chunk_id as varchar) chunk_id, sum(case path when 'dense' then 0.4e0 else 0.3e0 end / (60 + rank)) s from all_ group by 1, 2) select query_id, chunk_id, rank, round(s, 6) score from (select *, row_number() over (partition by query_id order by round(s, 9) desc, chunk_id) as rank from h_) where rank <= 10")
def d18(spark, d):
    return _out(retrieve.hybrid(_dense(spark, d), _sparse(spark, d), _graph(spark, d)))


@query("d19_hybrid_routed", f"{_HYBRID}, h_ as (select query_id, cast(chunk_id as varchar) chunk_id, sum(case path when 'dense' then 0.4e0 else 0.3e0 end / (60 + rank)) s from all_ where (path = 'dense' and rank <= 3 + query_id % 3) or (path = 'sparse' and rank <= 2) or (path = 'graph' and query_id % 3 = 1) group by 1, 2) select query_id, chunk_id, rank, round(s, 6) score from (select *, row_number() over (partition by query_id order by round(s, 9) desc, chunk_id) as rank from h_) where rank <= 10")
def d19(spark, d):
    k = F.col("query_id") % 3
    plans = _items(spark, d).select("query_id", (k + 3).alias("dense_k"), F.lit(2).alias("sparse_k"), F.when(k == 1, 3).otherwise(0).alias("hops"))
    return _out(retrieve.hybrid_routed(_dense(spark, d), _sparse(spark, d), _graph(spark, d), plans))


# ---- answers -----------------------------------------------------------------------------------------------------------


def _ranked(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("in/"), "source", F.lit(".txt")).alias("file_name"), F.col("text").alias("content"))
    # six chunks an item go to the texts, which stay where they are read
    return F.broadcast(_sparse(spark, d).where("rank <= 6")).join(docs, "chunk_id").withColumn("score", F.round(F.col("score") / 400, 6))


_RANKED = f"{_bm25()}, ranked_ as (select query_id, chunk_id, rank, round(score / 400, 6) score, 'in/' || source || '.txt' as file_name, text as content from top_ join documents on doc_id = chunk_id where rank <= 6)"
_VERDICT = "verdict_ as (select item_id as query_id, ['APPROVE', 'REVISE', 'REJECT'][item_id % 3 + 1] as verdict from benchmark)"


def _verdicts(spark, d):
    return _items(spark, d).select("query_id", F.element_at(F.array(*map(F.lit, ("APPROVE", "REVISE", "REJECT"))), (F.col("query_id") % 3 + 1).cast("int")).alias("verdict"))


_PIECES = "(select d.doc_id || '-' || (i // 400) as doc_id, substr(text, i + 1, 500) as text, source from documents d, unnest(range(0, length(text), 400)) t(i))"


@query("d20_context", f"with pieces_ as materialized {_PIECES}, {_bm25(docs='pieces_')}, ranked_ as (select query_id, chunk_id, rank, 'in/' || source || '.txt' as file_name, text as content from top_ join pieces_ on doc_id = chunk_id), e_ as (select query_id, rank, '[Source ' || rank || ': ' || left(list_last(string_split(file_name, '/')), 30) || ']' || chr(10) || content || chr(10) as e from ranked_), s_ as (select *, sum(length(e)) over (partition by query_id order by rank) so_far from e_) select query_id, count(*) n_used, sha256(string_agg(e, chr(10) order by rank)) as digest from s_ where so_far <= 4000 group by 1")
def d20(spark, d):
    """Chunks of 500 characters of all texts, searched where they are cut and assembled whole."""
    docs = read(spark, d, "documents")
    cores = spark.sparkContext.defaultParallelism
    # a large table is read in many parts and stays there, one of few parts is dealt out
    pieces = chunking.chunk_fixed(docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores), doc_id="doc_id")
    found = retrieve.bm25_scan(_items(spark, d), pieces, 10)
    # ten chunks an item go to the texts, which stay where they are read
    whole = F.broadcast(found).join(pieces.select("chunk_id", "document_id", "content"), "chunk_id")
    names = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("in/"), "source", F.lit(".txt")).alias("file_name"))
    return answers.context(F.broadcast(whole).join(names, "document_id"), 4000, "label").select("query_id", "n_used", F.sha2("context", 256).alias("digest"))


@query("d21_evidence", f"with {_RANKED} select query_id, rank, chunk_id, file_name, left(content, 500) snippet, score from ranked_")
def d21(spark, d):
    return answers.evidence(_ranked(spark, d))


_LEVEL = "case when {s} >= 0.7 then 'high' when {s} >= 0.4 then 'medium' when {s} >= 0.2 then 'low' else 'none' end"
_CONF1 = f"conf_ as (select v.query_id, verdict, n, case when n is null then 'none' when verdict = 'REJECT' then 'low' else {_LEVEL.format(s='s')} end as confidence, case when n is null then 0.0::double when verdict = 'REJECT' then 0.15::double else round(s, 3) end as score from (select v.query_id, verdict, n, (0.3e0 * least(top, 1e0) + 0.3e0 * case when n > 1 then greatest(0e0, 1 - var * 10) else 0.5e0 end + 0.2e0 * least(n / 3e0, 1e0) + 0.2e0 * 0.8e0) * case verdict when 'REVISE' then 0.8e0 else 1e0 end s from verdict_ v left join (select query_id, count(*) n, max(score) top, var_pop(score) var from ranked_ group by 1) r on r.query_id = v.query_id) v)"


@query("d22_confidence", f"with {_RANKED}, {_VERDICT}, {_CONF1} select query_id, confidence, score from conf_")
def d22(spark, d):
    return answers.confidence(_ranked(spark, d), _verdicts(spark, d), 1)


@query("d23_confidence_v2", f"with {_RANKED}, {_VERDICT}, r_ as (select query_id, count(*) n, min_by(score, rank) as fst, var_pop(score) filter (where rank <= 5) var from ranked_ group by 1), c_ as (select v.query_id, n, (0.40e0 * least(1e0, fst * 10) + 0.35e0 * case when n >= 2 then greatest(0e0, 1 - var * 100) else 0.5e0 end + 0.25e0 * least(1e0, n / 3e0)) * case verdict when 'REJECT' then 0.3e0 when 'REVISE' then 0.7e0 else 1e0 end s from verdict_ v left join r_ on r_.query_id = v.query_id) select query_id, case when n is null then 'none' else {_LEVEL.format(s='s')} end as confidence, case when n is null then 0.0::double else round(s, 3) end as score from c_")
def d23(spark, d):
    return answers.confidence(_ranked(spark, d), _verdicts(spark, d), 2)


@query("d24_confidence_factors", f"with {_RANKED}, {_VERDICT}, r_ as (select query_id, count(*) n, max(score) top from ranked_ group by 1), f_ as (select v.query_id, least(coalesce(top * 10, 0e0), 1e0) a, case when v.query_id % 4 = 0 then 0.5e0 when v.query_id % 4 = 1 then 0.7e0 else 1e0 end b, least(case when v.query_id % 4 > 0 then v.query_id % 4 else coalesce(n, 0) end / 3e0, 1e0) c, case verdict when 'APPROVE' then 1e0 when 'REVISE' then 0.5e0 else 0e0 end e from verdict_ v left join r_ on r_.query_id = v.query_id) select query_id, round(0.25e0 * a + 0.25e0 * b + 0.2e0 * c + 0.15e0 * 0.5e0 + 0.15e0 * e, 6) as score, {_LEVEL.format(s='(0.25e0 * a + 0.25e0 * b + 0.2e0 * c + 0.15e0 * 0.5e0 + 0.15e0 * e)')} as confidence from f_")
def d24(spark, d):
    v = _verdicts(spark, d).withColumn("n_cited", (F.col("query_id") % 4).cast("int"))
    return answers.confidence_factors(_ranked(spark, d), v).select("query_id", "score", "confidence")


def _packets(spark, d):
    a = _verdicts(spark, d).join(_items(spark, d).withColumnRenamed("text", "answer"), "query_id").withColumn("query_class", F.lit("SIMPLE")).withColumn("critic", F.lit("ok"))
    return answers.answer_packets(a, _ranked(spark, d))


@query("d25_answer_packets", f"with {_RANKED}, {_VERDICT}, {_CONF1} select c.query_id, case when verdict = 'REJECT' then {"'" + answers.ABSTENTION.replace(chr(39), chr(39) * 2) + "'"} || coalesce((select string_agg('- [' || file_name || ']: ' || left(content, 200) || '...', chr(10) order by rank) from ranked_ r where r.query_id = c.query_id and rank <= 3), '') else text end as answer, case when verdict = 'REJECT' then 'none' else confidence end as confidence, case when verdict = 'REJECT' then 0.1::double else score end as confidence_score, 'Query type: SIMPLE' || chr(10) || 'Retrieval: ' || coalesce(n, 0) || ' chunks found' || chr(10) || 'Verification: ' || verdict || chr(10) || 'Critic: ok' as reasoning_chain from conf_ c join benchmark b on b.item_id = c.query_id")
def d25(spark, d):
    return _packets(spark, d).select("query_id", "answer", "confidence", "confidence_score", "reasoning_chain")


@query("d26_evaluation", f"with {_bm25()}, gold_ as (select item_id as query_id, doc_id as chunk_id from benchmark b join documents d on contains(d.text, b.text)) select count(*) n_queries, round(avg(recall), 6) recall, round(avg(rr), 6) mrr from (select g.query_id, avg(case when rank is null then 0e0 else 1e0 end) recall, coalesce(1e0 / min(rank), 0) rr from gold_ g left join top_ t on t.query_id = g.query_id and t.chunk_id = g.chunk_id group by 1)")
def d26(spark, d):
    gold = retrieve.chunks_with_text(_items(spark, d), _chunks(spark, d), _index(spark, d).tables())
    return answers.evaluate_ranking(_sparse(spark, d), gold)


_SHORT = "select item_id * 2 as query_id, list_last(string_split(text, ' ')) as asked from benchmark union all select item_id * 2 + 1, left(text, length(string_split(text, ' ')[1]) + 3) from benchmark"


@query("d26_short_texts", f"select query_id, doc_id as chunk_id from ({_SHORT}) join documents on contains(text, asked) where trim(asked) <> ''")
def d26c(spark, d):
    """The documents that contain an item's last word, and its first word with the two characters behind."""
    b = read(spark, d, "benchmark")
    words = F.split("text", " ")
    head = F.substr(F.col("text"), F.lit(1), F.length(F.get(words, F.lit(0))) + 3)
    asked = b.select((F.col("item_id") * 2).alias("query_id"), F.element_at(words, -1).alias("text")).unionAll(b.select(F.col("item_id") * 2 + 1, head))
    return retrieve.chunks_with_text(asked, _chunks(spark, d), _index(spark, d).tables())


@query("d26_answers", f"with {_RANKED}, {_VERDICT}, cited_ as (select b.item_id, max(case when contains(lower(content), lower(trim(b.text))) then 1 else 0 end) ok from benchmark b join ranked_ on query_id = item_id where rank <= 3 group by 1), none_ as (select item_id, not exists (select 1 from documents d where contains(d.text, b.text)) as bare from benchmark b) select (select count(*) from cited_) n_cited, (select sum(ok)::bigint from cited_) n_supported, (select round(avg(ok), 6) from cited_) support_rate, count(*) n, count(*) filter (bare and verdict = 'REJECT') rightly, count(*) filter (not bare and verdict = 'REJECT') wrongly, count(*) filter (bare and verdict <> 'REJECT') missed, round(avg(case when bare = (verdict = 'REJECT') then 1e0 else 0e0 end), 6) correct_rate from none_ join verdict_ on query_id = item_id")
def d26d(spark, d):
    """Whether the first three chunks contain what an item says, and whether rejected items are those that no document has."""
    items, verdicts = _items(spark, d), _verdicts(spark, d)
    support = answers.citation_support(items.withColumnRenamed("text", "claim"), _ranked(spark, d).where("rank <= 3"))
    found = retrieve.chunks_with_text(items, _chunks(spark, d), _index(spark, d).tables()).select("query_id").distinct().withColumn("found", F.lit(True))
    given = verdicts.join(found, "query_id", "left").select("query_id", (F.col("verdict") == "REJECT").alias("abstained"), F.col("found").isNull().alias("unanswerable"))
    return support.join(answers.abstention_correctness(given))


@query("d26_latency", "select event_type, count(value) n, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95 from events group by 1")
def d26b(spark, d):
    return answers.latency_percentiles(read(spark, d, "events"), "value", "event_type")


@query("e22_confidence_metrics", f"with {_RANKED}, {_VERDICT}, {_CONF1} select verdict as verification, count(*) n, round(avg(case when verdict = 'REJECT' then 0.1::double else score end), 6) mean_score, round(avg(case when verdict = 'REJECT' or confidence = 'none' then 1e0 else 0e0 end), 6) abstained from conf_ group by 1")
def e22(spark, d):
    return answers.confidence_metrics(_packets(spark, d))


@query("a14_hashed_terms")
def a14(spark, d):
    from pyspark.ml.functions import vector_to_array

    return files.hashed_terms(read(spark, d, "documents").select("doc_id", "text"), "text", 64).select("doc_id", F.transform(vector_to_array("vector"), lambda x: F.round(x, 6)).alias("embedding"))
