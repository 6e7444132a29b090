"""Queries over the memory tables, the graph and ingestion (C, E, F, G), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.operators import graph, ingest, insights, memory
from mnemoframe.plans.store import read, sql, store, ways
from mnemoframe.scratch import new_path
from mnemoframe.sources import versions

CATALOG: dict[str, tuple] = {}


def query(name: str, text: str | None = None):
    def add(f):
        CATALOG[name] = (f, None if text is None else sql(text))
        return f

    return add


def _ids(s, table="nodes", every="id", like="s%"):
    return s[table].where(F.col(every).like(like)).select(every)


# ---- E: relational queries -------------------------------------------------------------------------------------------


@query("e01_entity_detail", """select n.id, n.name, coalesce(o.n, 0) n_out, coalesce(o.first, '') first_out, coalesce(i.n, 0) n_in, coalesce(b.n, 0) n_beliefs from nodes_ n
 left join (select source, count(*) n, min(relationship || ':' || name) as first from edges_ e join nodes_ t on t.id = e.target group by 1) o on o.source = n.id
 left join (select target, count(*) n from edges_ group by 1) i on i.target = n.id left join (select node_id, count(*) n from beliefs_ where superseded_by is null group by 1) b on b.node_id = n.id""")
def e01(spark, d):
    s = store(spark, d)
    x = memory.entity_detail(s, s["nodes"])
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    first = F.coalesce(F.transform("outgoing", lambda e: F.concat(e["relationship"], F.lit(":"), e["other_name"]))[0], F.lit(""))
    return x.select("id", "name", n("outgoing").alias("n_out"), first.alias("first_out"), n("incoming").alias("n_in"), n("beliefs").alias("n_beliefs"))


@query("e02_search_entities", "select id, type, name, mention_count, (select count(*) from nodes_ where lower(name) like '%ring%' and type = 'PRODUCT') total from nodes_ where lower(name) like '%ring%' and type = 'PRODUCT' order by mention_count desc, id limit 20 offset 10")
def e02(spark, d):
    return memory.search_entities(store(spark, d)["nodes"], "ring", "PRODUCT", limit=20, offset=10).select("id", "type", "name", "mention_count", "total")


@query("e03_update_entities", "select id, case when type = 'ORGANIZATION' then 'GROUP' else type end as type, case when type = 'ORGANIZATION' then upper(name) else name end as name, mention_count, case when type = 'ORGANIZATION' then timestamp '2024-01-01' else last_seen end as last_seen from nodes_")
def e03(spark, d):
    n = store(spark, d)["nodes"]
    patch = n.where("type = 'ORGANIZATION'").select("id", F.upper("name").alias("name"), F.lit("GROUP").alias("type"))
    return memory.update_entities(n, patch, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))).select("id", "type", "name", "mention_count", "last_seen")


@query("e04_delete_entities", """select 'nodes' as tbl, count(*) n from nodes_ where name not like '%ring%' union all select 'edges', count(*) from edges_ where target not in (select id from nodes_ where name like '%ring%')
 union all select 'beliefs', count(*) from beliefs_ where node_id not in (select id from nodes_ where name like '%ring%') union all select 'node_chunks', count(*) from node_chunks_ where node_id not in (select id from nodes_ where name like '%ring%')""")
def e04(spark, d):
    s = store(spark, d)
    out = memory.delete_entities(s, s["nodes"].where(F.col("name").like("%ring%")))
    rows = [out[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tbl"), "n") for t in ("nodes", "edges", "beliefs", "node_chunks")]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])


@query("e05_merge_entities", """with to_ as (select id old, 'p' || (2 * (cast(substr(id, 2) as bigint) // 2)) new from nodes_ where type = 'PRODUCT' and cast(substr(id, 2) as bigint) % 2 = 1),
 e_ as (select e.id, source, coalesce(new, target) target, relationship from edges_ e left join to_ on old = target), k_ as (select target, count(*) n_edges, min(id) first_edge from (select min(id) id, source, target, relationship from e_ group by 2, 3, 4) group by 1)
 select n.id, n.name, n.mention_count + coalesce(m.mention_count, 0) as mention_count, coalesce(n_edges, 0) n_edges, first_edge from nodes_ n left join (select new, mention_count from nodes_ join to_ on old = id) m on m.new = n.id left join k_ on k_.target = n.id where n.id not in (select old from to_)""")
def e05(spark, d):
    s = store(spark, d)
    k = F.substr("id", F.lit(2)).cast("long")
    pairs = s["nodes"].where((F.col("type") == "PRODUCT") & (k % 2 == 1)).select(F.concat(F.lit("p"), (k - 1).cast("string")).alias("primary"), F.col("id").alias("secondary"))
    m = memory.merge_entities(s, pairs)
    e = m["edges"].groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n_edges"), F.min("id").alias("first_edge"))
    return m["nodes"].join(e, "id", "left").select("id", "name", "mention_count", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "first_edge")


@query("e06_relationships", "select e.id, source, target, relationship, a.name source_name, b.name target_name, created_at from edges_ e join nodes_ a on a.id = source join nodes_ b on b.id = target where relationship = 'supplies_A' order by created_at desc, e.id limit 100")
def e06(spark, d):
    return memory.relationships(store(spark, d), kind="supplies_A")


@query("e07_delete_relationships", "select relationship, count(*) n from edges_ where created_at >= timestamp '1996-01-01' group by 1")
def e07(spark, d):
    e = store(spark, d)["edges"]
    return memory.delete_rows(e, e.where(F.col("created_at") < F.lit("1996-01-01").cast("timestamp_ntz"))).groupBy("relationship").agg(F.count(F.lit(1)).alias("n"))


@query("e08_add_beliefs", "select accepted, count(*) n, round(sum(confidence), 2) total from (select 'p' || (user_id * 997) in (select id from nodes_) accepted, value confidence from events) group by 1")
def e08(spark, d):
    s = store(spark, d)
    new = read(spark, d, "events").select(F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("p"), (F.col("user_id") * 997).cast("string")).alias("node_id"), F.col("event_type").alias("belief"), F.col("value").alias("confidence"), "ts")
    kept, rejected = memory.add_beliefs(s | {"beliefs": s["beliefs"].limit(0)}, new)
    count = lambda x, ok: x.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 2).alias("total")).select(F.lit(ok).alias("accepted"), "n", "total").where("n > 0")
    return count(kept, True).unionByName(count(rejected, False))


@query("e09_supersede_beliefs", "select count(*) n, count(superseded_by) n_superseded, count(*) filter (where superseded_by like 'x%') n_new from (select case when superseded_by is null then 'x' || id else superseded_by end superseded_by from beliefs_ union all select null from beliefs_ where superseded_by is null)")
def e09(spark, d):
    b = store(spark, d)["beliefs"]
    new = b.where("superseded_by is null").select(F.concat(F.lit("x"), F.col("id")).alias("id"), "node_id", F.upper("belief").alias("belief"), "confidence", "ts", F.lit(None).cast("string").alias("superseded_by"), F.col("id").alias("replaces"))
    return memory.supersede_beliefs(b, new).agg(F.count(F.lit(1)).alias("n"), F.count("superseded_by").alias("n_superseded"), F.count_if(F.col("superseded_by").like("x%")).alias("n_new"))


@query("e10_current_beliefs", "select id, node_id, belief, confidence, ts from beliefs_ where superseded_by is null")
def e10(spark, d):
    return memory.current(store(spark, d)["beliefs"]).select("id", "node_id", "belief", "confidence", "ts")


@query("e11_search_memory", "select chunk_id, c.document_id, filename, modality, category, content, ingested_at from chunks_ c join docs_ d on d.document_id = c.document_id where content ilike '%red%ring%' and modality = 'pdf' order by ingested_at desc, chunk_id limit 50")
def e11(spark, d):
    return memory.search_memory(store(spark, d), "red%RING", modality="pdf")


@query("e12_document_entities", "select distinct c.document_id, n.id, n.name, n.mention_count from chunks_ c join node_chunks_ k on k.chunk_id = c.chunk_id join nodes_ n on n.id = k.node_id")
def e12(spark, d):
    s = store(spark, d)
    return memory.document_entities(s, s["documents"]).select("document_id", "id", "name", "mention_count")


@query("e13_entity_documents", "select distinct n.id, c.document_id, filename, ingested_at from nodes_ n join node_chunks_ k on n.id = k.node_id join chunks_ c on c.chunk_id = k.chunk_id join docs_ d on d.document_id = c.document_id where n.type = 'ORGANIZATION'")
def e13(spark, d):
    s = store(spark, d)
    return memory.entity_documents(s, _ids(s)).select("id", "document_id", "filename", "ingested_at")


@query("e14_type_counts", "select relationship as kind, count(*) n from edges_ group by 1 union all select type, count(*) from nodes_ group by 1")
def e14(spark, d):
    s = store(spark, d)
    return memory.type_counts(s["edges"], "relationship").unionByName(memory.type_counts(s["nodes"], "type"))


_PAGE = "select d.document_id, filename, modality, ingested_at, min(summary) summary, min(category) category from docs_ d left join chunks_ c on c.document_id = d.document_id where modality = 'text' group by 1, 2, 3, 4 order by ingested_at desc, d.document_id limit 20 offset 20"


@query("e15_timeline", _PAGE)
def e15(spark, d):
    return memory.timeline(store(spark, d), modality="text", page=2)


@query("e15_timeline_total", "select (select count(distinct d.document_id) from docs_ d left join chunks_ c on c.document_id = d.document_id where modality = 'text') total, (select count(distinct d.document_id) from docs_ d join chunks_ c on c.document_id = d.document_id where category = 'R' and content ilike '%red%') n_found")
def e15b(spark, d):
    s = store(spark, d)
    found = memory.timeline_total(s, category="R", search="red").withColumnRenamed("total", "n_found")
    return memory.timeline_total(s, modality="text").join(found)


@query("e16_timeline_entities", f"with page_ as ({_PAGE}) select p.document_id, string_agg(distinct n.name, '|' order by n.name) as names from page_ p join chunks_ c on c.document_id = p.document_id join node_chunks_ k on k.chunk_id = c.chunk_id join nodes_ n on n.id = k.node_id group by 1")
def e16(spark, d):
    s = store(spark, d)
    return memory.timeline_entities(s, memory.timeline(s, modality="text", page=2)).select("document_id", F.array_join("names", "|").alias("names"))


@query("e17_memory_stats", """select 'documents' measure, 'all' kind, count(*) n from docs_ union all select 'chunks', 'all', count(*) from chunks_ union all select 'nodes', 'all', count(*) from nodes_ union all select 'edges', 'all', count(*) from edges_
 union all select 'modality', modality, count(*) from docs_ group by 2 union all select 'category', category, count(*) from chunks_ group by 2 union all select 'type', type, count(*) from nodes_ group by 2""")
def e17(spark, d):
    return memory.memory_stats(store(spark, d))


@query("e18_memory_detail", "select d.document_id, coalesce(string_agg(content, '|' order by chunk_index), '') as chunks, max_by(summary, chunk_index) summary, max_by(category, chunk_index) category, coalesce(string_agg('check ' || category || ',' || content, ',' order by chunk_index) filter (where category <> 'N'), '') as action_items from docs_ d left join chunks_ c on c.document_id = d.document_id group by 1")
def e18(spark, d):
    s = store(spark, d)
    s["chunks"] = s["chunks"].withColumn("action_items", F.when(F.col("category") != "N", F.array(F.concat(F.lit("check "), "category"), "content")))
    x = memory.memory_detail(s, s["documents"])
    return x.select("document_id", F.coalesce(F.array_join("action_items", ","), F.lit("")).alias("action_items"), F.coalesce(F.array_join(F.transform("chunks", lambda c: c["content"]), "|"), F.lit("")).alias("chunks"), "summary", "category")


_WAYS = "go_ as (select distinct 'c' || c_custkey as source, 'n' || c_nationkey as target from customer union select distinct 'n' || n_nationkey, 'r' || n_regionkey from nation union select distinct 'r' || r_regionkey, 's' || s_suppkey from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey), gn_ as (select source as id from go_ union select target from go_)"


def _way_nodes(e):
    return e.select(F.col("source").alias("id")).union(e.select("target")).distinct()


@query("e19_graph_view", f"with {_WAYS}, top_ as (select id from (select id, count(*) n from (select source id from go_ union all select target from go_) group by 1) order by n desc, id limit 100) select source, target from go_ where source in (select id from top_) and target in (select id from top_)")
def e19(spark, d):
    """The busiest nodes among customers, nations, regions and suppliers, and the ways between them."""
    e = ways(spark, d)
    nodes = graph.degrees(e).withColumnRenamed("degree", "mention_count")
    return memory.graph_view({"nodes": nodes, "edges": e})[1].select("source", "target")


@query("e20_recent", "select event_id, ts, event_type from events order by ts desc, event_id desc limit 500")
def e20(spark, d):
    return memory.recent(read(spark, d, "events"), 500, "ts", "event_id").select("event_id", "ts", "event_type")


@query("e21_store_summary", "select (select count(*) from nodes_) n_nodes, (select count(*) from edges_) n_edges, (select count(*) from docs_) n_documents")
def e21(spark, d):
    return memory.store_summary(store(spark, d))


# ---- F: graph ----------------------------------------------------------------------------------------------------------


@query("f01_degree_centrality", "select id, degree, round(degree / ((select count(*) from nodes_) - 1.0::double), 6) centrality from (select n.id, coalesce(c, 0) as degree from nodes_ n left join (select id, count(*) c from (select source id from arcs_ union all select target from arcs_) group by 1) x on x.id = n.id)")
def f01(spark, d):
    s = store(spark, d)
    return graph.degree_centrality(s["nodes"], s["edges"])


@query("f02_betweenness", f"with {_WAYS}, piv_ as (select id from gn_ order by id limit 100), n_ as (select count(*) n from gn_), from_ as (select a.source as c, a.target as nat, b.target as reg from go_ a join go_ b on b.source = a.target join piv_ on piv_.id = a.source where a.source like 'c%'), ends_ as (select source as reg, count(*) k from go_ where source like 'r%' group by 1), sum_ as (select nat as id, sum(1 + coalesce(k, 0)) s from from_ left join ends_ using (reg) group by 1 union all select reg, sum(coalesce(k, 0)) from from_ left join ends_ using (reg) group by 1) select g.id, round(coalesce(s, 0)::double * (n / least(n, 100)::double / greatest(1, (n - 1) * (n - 2))), 6) as betweenness from gn_ g cross join n_ left join sum_ on sum_.id = g.id")
def f02(spark, d):
    e = ways(spark, d)
    return graph.betweenness(_way_nodes(e), e)


@query("f03_pagerank", "with n_ as (select count(*) n from nodes_), out_ as (select source, count(*) k from arcs_ group by 1), links_ as (select a.source, a.target, o.k from arcs_ a join out_ o on o.source = a.source), pr_ as (select id, 1e0 / n as rank, 0 as step, 1e9 as moved from nodes_ cross join n_ union all select id, rank, step, sum(abs(rank - old)) over () from (select r.id, r.rank as old, r.step + 1 as step, 0.15e0 / n + 0.85e0 * (coalesce(g.got, 0) + l.lost / n) as rank from pr_ r cross join n_ cross join (select coalesce(sum(p.rank), 0) lost from pr_ p where p.id not in (select source from out_)) l left join (select k.target, sum(p.rank / k.k) got from links_ k join pr_ p on p.id = k.source group by 1) g on g.target = r.id where r.moved >= n * 1e-6 and r.step < 100)) select id, round(rank, 9) as rank from pr_ where step = (select max(step) from pr_)")
def f03(spark, d):
    s = store(spark, d)
    return graph.pagerank(s["nodes"], s["edges"]).select("id", F.round("rank", 9).alias("rank"))


_LABELS = """nbs_ as (select source as id, target as nb from go_ union select target, source from go_), lab_ as (select id, id as label, -1 as turn, 1 as moved from gn_ union all select id, label, turn, sum(case when label <> old then 1 else 0 end) over () from (select l.id, l.label as old, l.turn + 1 as turn, case when ascii(md5(l.id)) % 2 = (l.turn + 1) % 2 and b.best is not null then b.best else l.label end as label
 from lab_ l left join (select id, arg_min(label, struct_pack(n := -n, other := other, label := label)) as best from (select v.id, v.label, count(*) n, v.label <> o.label as other from (select nbs_.id, p.label from nbs_ join lab_ p on p.id = nbs_.nb) v join lab_ o on o.id = v.id group by v.id, v.label, o.label) group by id) b on b.id = l.id where l.turn + 1 < 20 and not (l.turn % 2 = 1 and l.moved = 0)))"""


@query("f04_communities", f"with {_WAYS}, {_LABELS}, end_ as (select id, label from lab_ where turn = (select max(turn) from lab_)), deg_ as (select id, count(*) n from (select source id from go_ union all select target from go_) group by 1) select label as community, count(*) as size, array_to_string(list(id order by n desc, id)[1:50], '|') as members from end_ join deg_ using (id) group by 1")
def f04(spark, d):
    e = ways(spark, d)
    nodes = graph.degrees(e).withColumnRenamed("degree", "mention_count").withColumn("name", F.col("id"))
    return graph.communities(nodes, e).select("community", "size", F.array_join("members", "|").alias("members"))


@query("f05_khop", "with seed_ as (select id from nodes_ where cast(substr(id, 2) as bigint) % 100 = 0), h1_ as (select distinct s.id seed, nb as id from seed_ s join nb_ on nb_.id = s.id), h2_ as (select distinct seed, nb as id from h1_ join nb_ using (id)) select id seed, id, 0 dist from seed_ union all select seed, id, 1 from h1_ union all select h2_.seed, h2_.id, 2 from h2_ where h2_.seed <> h2_.id and not exists (select 1 from h1_ where h1_.seed = h2_.seed and h1_.id = h2_.id)")
def f05(spark, d):
    """Around every supplier and part whose number is divisible by 100."""
    s = store(spark, d)
    return graph.khop(s["edges"], s["nodes"].where("cast(substr(id, 2) as bigint) % 100 = 0"), 2)


@query("f06_subgraph", "with seed_ as (select id from nodes_ where cast(substr(id, 2) as bigint) % 100 = 0), one_ as (select distinct nb as id from nb_ where id in (select id from seed_)), two_ as (select distinct nb as id from nb_ where id in (select id from one_)), near_ as (select id, min(dist) dist from (select id, 0 dist from seed_ union all select id, 1 from one_ union all select id, 2 from two_) group by 1) select near_.id, name, dist, dist = 0 as is_seed from near_ join nodes_ using (id)")
def f06(spark, d):
    """As asked for by the names of those suppliers and parts, in capitals, and by names that nobody has."""
    s = store(spark, d)
    asked = s["nodes"].where("cast(substr(id, 2) as bigint) % 100 = 0")
    names = asked.select(F.concat(F.lit(" "), F.upper("name"), F.lit(" ")).alias("name")).unionAll(asked.select(F.concat(F.lit("no "), "name")))
    return graph.subgraph(s["nodes"], s["edges"], names)[0].select("id", "name", "dist", "is_seed")


@query("f07_simple_paths", f"with {_WAYS}, asked_ as (select distinct 'c' || o_custkey as source, 's' || l_suppkey as target from orders join lineitem on l_orderkey = o_orderkey) select p.source, p.target, p.source || '>' || a.target || '>' || b.target || '>' || p.target as path from asked_ p join go_ a on a.source = p.source join go_ b on b.source = a.target join go_ c on c.source = b.target and c.target = p.target")
def f07(spark, d):
    """The ways from every customer to the suppliers of its orders."""
    tag = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    asked = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(tag("c", "o_custkey").alias("source"), tag("s", "l_suppkey").alias("target"))
    return graph.simple_paths(ways(spark, d), asked, 3).select("source", "target", F.array_join("path", ">").alias("path"))


@query("f08_jaccard", """with size_ as (select id, count(*) n from nb_ group by 1), both_ as (select a.id, b.id other, count(*) c from nb_ a join nb_ b on a.nb = b.nb and a.id <> b.id where a.id like 's%' group by 1, 2),
 sim_ as (select b.id, other, round(c / (x.n + y.n - c)::double, 4) similarity from both_ b join size_ x on x.id = b.id join size_ y on y.id = other) select * from (select *, row_number() over (partition by id order by similarity desc, other) as rank from sim_ where similarity > 0) where rank <= 10""")
def f08(spark, d):
    s = store(spark, d)
    return graph.jaccard_topk(s["edges"], _ids(s))


@query("f09_graph_stats", "with all_ as (select id, nb from nb_ union select id, id from nodes_), lab_ as (select id, id as label, 0 as step, 1 as changed from nodes_ union all select id, label, step, sum(case when label <> old then 1 else 0 end) over () from (select l.id, l.label as old, l.step + 1 as step, g.least as label from lab_ l join (select a.id, min(p.label) as least from all_ a join lab_ p on p.id = a.nb group by 1) g on g.id = l.id where l.changed > 0)), end_ as (select label, count(*) k from lab_ where step = (select max(step) from lab_) group by 1), deg_ as (select id, count(*) k from (select source id from arcs_ union all select target from arcs_) group by 1), c_ as (select (select count(*) from nodes_) n, (select count(*) from arcs_) m) select n n_nodes, m n_edges, round(m / (n * (n - 1))::double, 6) density, (select count(*) from end_) components, (select max(k) from end_) largest, round(2 * m / n::double, 6) avg_degree, (select max(k) from deg_) max_degree, (select string_agg(type || '=' || n, ',' order by type) from (select type, count(*) n from nodes_ group by 1)) node_types, (select string_agg(relationship || '=' || n, ',' order by relationship) from (select relationship, count(*) n from edges_ group by 1)) relationship_types from c_")
def f09(spark, d):
    s = store(spark, d)
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["kind"], F.lit("="), x["n"].cast("string"))), ",").alias(c)
    x = graph.graph_stats(s["nodes"], s["edges"])
    return x.select(*(c for c in x.columns if not c.endswith("_types")), said("node_types"), said("relationship_types"))


@query("f10_components", "select 'c' || c_custkey as id, 'c' || min(c_custkey) over (partition by c_nationkey) as component from customer")
def f10(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    hub = c.groupBy("c_nationkey").agg(F.min("id").alias("target"))
    e = c.join(hub, "c_nationkey").select(F.col("id").alias("source"), "target")
    return graph.components(c, e).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("c"), F.col("component").cast("string")).alias("component"))


@query("f11_lookup", "select id, name from nodes_ where lower(trim(name)) in (select lower(trim(' ' || upper(s_name) || ' ')) from supplier)")
def f11(spark, d):
    return graph.lookup(store(spark, d)["nodes"], read(spark, d, "supplier").select(F.concat(F.lit(" "), F.upper("s_name"), F.lit(" ")).alias("name"))).select("id", "name")


@query("f12_cooccurring", "with of_ as (select distinct node_id, document_id from node_chunks_ k join chunks_ c on c.chunk_id = k.chunk_id) select x.node_id a, y.node_id b, count(*) n_documents from of_ x join of_ y on x.document_id = y.document_id and x.node_id < y.node_id group by 1, 2 order by 3 desc, 1, 2 limit 20")
def f12(spark, d):
    s = store(spark, d)
    return graph.cooccurring(s["node_chunks"], s["chunks"])


# ---- C: ingestion --------------------------------------------------------------------------------------------------------

_OLD = "select 'part/' || p_partkey path, sha256(p_name) checksum from part where p_size < 40"
_NEW = "select 'part/' || p_partkey path, sha256(case when p_size % 5 = 0 then p_name || 'x' else p_name end) checksum from part where p_size > 10"


def _snapshots(spark, d):
    p = read(spark, d, "part")
    path = F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path")
    name = F.when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name"))
    return p.where("p_size < 40").select(path, F.sha2("p_name", 256).alias("checksum")), p.where("p_size > 10").select(path, F.sha2(name, 256).alias("checksum"))


@query("c01_diff_snapshots", f"with o_ as ({_OLD}), n_ as ({_NEW}) select coalesce(o_.path, n_.path) path, case when o_.path is null then 'created' when n_.path is null then 'deleted' else 'modified' end as change from o_ full join n_ on o_.path = n_.path where o_.checksum is distinct from n_.checksum")
def c01(spark, d):
    old, new = _snapshots(spark, d)
    return ingest.diff_snapshots(old, new).select("path", "change")


@query("c02_first_run", f"with n_ as ({_NEW}) select path, 'none' as change from n_ where false")
def c02(spark, d):
    _, new = _snapshots(spark, d)
    return ingest.diff_snapshots(new.limit(0), new).select("path", "change")


@query("c03_moves", "select 'new/' || p_partkey as path, 'moved' as change, 'old/' || p_partkey as old_path from part")
def c03(spark, d):
    p = read(spark, d, "part")
    snap = lambda folder: p.select(F.concat(F.lit(folder), F.col("p_partkey").cast("string")).alias("path"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("checksum"))
    return ingest.diff_snapshots(snap("old/"), snap("new/"), detect_moves=True).select("path", "change", "old_path")


@query("c04_upsert", "select modality, count(*) n, count(*) filter (where checksum = sha256('changed')) n_changed from (select modality, case when modality = 'pdf' then sha256('changed') else checksum end checksum from docs_) group by 1")
def c04(spark, d):
    docs = store(spark, d)["documents"]
    batch = docs.where("modality <> 'json'").withColumn("checksum", F.when(F.col("modality") == "pdf", F.sha2(F.lit("changed"), 256)).otherwise(F.col("checksum")))
    new, _ = ingest.upsert(docs, batch)
    return new.groupBy("modality").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("checksum") == F.sha2(F.lit("changed"), 256)).alias("n_changed"))


@query("c04_versions", "select 0 as version, modality, count(*) n, 0::bigint n_changed from docs_ group by 2 union all select 1, modality, count(*), count(*) filter (where checksum = sha256('changed')) from (select modality, case when modality = 'pdf' then sha256('changed') else checksum end checksum from docs_) group by 2")
def c04b(spark, d):
    """Two versions of a table, the second an upsert that is seen at once; both can be read."""
    root = new_path(spark, "versions")
    docs = store(spark, d)["documents"]
    versions.commit(docs, root)
    versions.upsert_table(docs.where("modality = 'pdf'").withColumn("checksum", F.sha2(F.lit("changed"), 256)), root)
    of = lambda v: versions.current(spark, root, v).groupBy("modality").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("checksum") == F.sha2(F.lit("changed"), 256)).alias("n_changed")).select(F.lit(v).alias("version"), "modality", "n", "n_changed")
    return of(0).unionAll(of(1))


@query("c05_status", "select case when document_id in (select document_id from chunks_) then 'processed' else 'processing' end as status, 'pending' enrichment_status, count(*) n from docs_ group by 1, 2")
def c05(spark, d):
    s = store(spark, d)
    return ingest.with_status(s["documents"].drop("status"), s["chunks"]).groupBy("status", "enrichment_status").agg(F.count(F.lit(1)).alias("n"))


_MENTIONS = "m_ as (select l_orderkey || '-' || l_linenumber chunk_id, l_linenumber pos, upper(s_name) as name, 'ORGANIZATION' as type, ts from lines_ join supplier on supp = s_suppkey)"


def _mentions(spark, d):
    from mnemoframe.plans.store import lines

    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("supp"), "s_name")
    chunk = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    m = lines(spark, d).join(s, "supp").select(chunk.alias("chunk_id"), F.col("l_linenumber").alias("pos"), F.upper("s_name").alias("name"), F.lit("ORGANIZATION").alias("type"), "ts", "flag")
    return m.drop("flag"), m.select(F.col("name").alias("source"), F.concat(F.lit("flag "), F.col("flag")).alias("target"), F.lit("has").alias("relationship"), "chunk_id", "ts")


@query("c07_build_nodes", f"with {_MENTIONS} select sha256(lower(name)) id, name, type, 2 * count(*) mention_count, min(ts) first_seen, max(ts) last_seen from m_ group by name, type")
def c07(spark, d):
    return ingest.build_nodes(*_mentions(spark, d))


@query("c08_build_edges", "select sha256(lower(s_name)) source, sha256('flag ' || lower(flag)) target, 'has' relationship, min(ts) created_at from lines_ join supplier on supp = s_suppkey group by 1, 2, 3")
def c08(spark, d):
    return ingest.build_edges(_mentions(spark, d)[1]).select("source", "target", "relationship", "created_at")


@query("c09_delete_documents", "with k_ as (select document_id from docs_ where modality <> 'pdf') select 'documents' tbl, count(*) n from k_ union all select 'chunks', count(*) from chunks_ where document_id in (select document_id from k_) union all select 'node_chunks', count(*) from node_chunks_ where chunk_id in (select chunk_id from chunks_ where document_id in (select document_id from k_))")
def c09(spark, d):
    s = store(spark, d)
    out = ingest.delete_documents(s, s["documents"].where("modality = 'pdf'"))
    rows = [out[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tbl"), "n") for t in ("documents", "chunks", "node_chunks")]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


@query("c10_enrichment", "select d.document_id, left(coalesce(string_agg(content, chr(10) order by chunk_index) filter (where chunk_index < 3), ''), 3000) prompt_text, case modality when 'text' then 'completed' when 'pdf' then 'failed' else 'deferred' end enrichment_status, case modality when 'text' then filename else '' end summary from docs_ d left join chunks_ c on c.document_id = d.document_id group by d.document_id, modality, filename")
def c10(spark, d):
    s = store(spark, d)
    said = F.when(F.col("modality") == "text", F.concat(F.lit("Here: "), F.to_json(F.struct(F.col("filename").alias("summary"))), F.lit(" done"))).when(F.col("modality") == "pdf", F.lit("sorry"))
    responses = s["documents"].select("document_id", said.alias("response")).where("response is not null")
    done = ingest.apply_enrichment(s["documents"], responses)
    return done.join(ingest.enrichment_input(s["chunks"]), "document_id", "left").select("document_id", F.coalesce("prompt_text", F.lit("")).alias("prompt_text"), "enrichment_status", "summary")


@query("c11_retry_schedule", "select event_id, cast(event_id % 5 as int) attempts, case when event_id % 5 < 3 then 'retry' else 'dead_letter' end as action, case when event_id % 5 < 3 then cast(least(2 ** (event_id % 5), 30) as int) end as delay_s from events")
def c11(spark, d):
    return ingest.retry_schedule(read(spark, d, "events").select("event_id", (F.col("event_id") % 5).cast("int").alias("attempts")))


@query("c12_token_slots", "select event_id, user_id, n * 600000000 + max(us - n * 600000000) over (partition by user_id order by us, event_id rows unbounded preceding) slot_us from (select event_id, user_id, epoch_us(ts) us, row_number() over (partition by user_id order by ts, event_id) n from events)")
def c12(spark, d):
    """A slot every ten minutes for each user."""
    return ingest.token_slots(read(spark, d, "events"), 0.1, key="user_id").select("event_id", "user_id", "slot_us")


@query("c12_token_queue", "select event_id, n * 600000 + max(us - n * 600000) over (order by us, event_id rows unbounded preceding) slot_us from (select event_id, epoch_us(ts) us, row_number() over (order by ts, event_id) n from events)")
def c12b(spark, d):
    """One queue of all events, a hundred slots a minute."""
    return ingest.token_slots(read(spark, d, "events"), 100).select("event_id", "slot_us")


@query("c13_counters", "select count(*) filter (where event_type = 'view') processed, count(*) filter (where event_type = 'error') failed, cast(sum(event_id % 7) as bigint) chunks, max(ts) last_scan from events")
def c13(spark, d):
    e = read(spark, d, "events").select(F.when(F.col("event_type") == "view", "processed").when(F.col("event_type") == "error", "failed").otherwise("other").alias("status"), (F.col("event_id") % 7).alias("n_chunks"), "ts")
    return ingest.ingest_counters(e).select("processed", "failed", "chunks", "last_scan")


# ---- G: insights -----------------------------------------------------------------------------------------------------------


@query("g01_connections", "select n.id, count(distinct nb) n, n.name || ' is connected to ' || count(distinct nb) || ' entities: ' || array_to_string(list_sort(list(distinct m.name))[1:5], ', ') as description from nodes_ n join nb_ on nb_.id = n.id join nodes_ m on m.id = nb where n.type = 'PRODUCT' group by n.id, n.name having count(distinct nb) >= 2")
def g01(spark, d):
    s = store(spark, d)
    return insights.connections(_ids(s, like="p%"), s["nodes"], s["edges"]).select("id", "n", "description")


@query("g02_contradictions", "select chunk_id, belief_id from (select chunk_id, belief_id, row_number() over (partition by chunk_id order by ts desc, belief_id) r from (select distinct k.chunk_id, b.id belief_id, b.ts from node_chunks_ k join beliefs_ b on b.node_id = k.node_id where superseded_by is null)) where r <= 10")
def g02(spark, d):
    s = store(spark, d)
    return insights.contradiction_candidates(s["chunks"], s["node_chunks"], s["beliefs"]).select("chunk_id", "belief_id")


@query("g02_belief_changes", "select id, before, belief from (select *, lag(belief) over (partition by node_id order by ts, id) before from beliefs_) where before <> belief")
def g02b(spark, d):
    return insights.belief_changes(store(spark, d)["beliefs"]).select("id", "before", "belief")


@query("g03_digest", "with top_ as (select * from nodes_ order by mention_count desc, id limit 10) select (select count(*) from docs_) n_documents, (select string_agg(category || '=' || n, ',' order by category) from (select category, count(distinct document_id) n from chunks_ group by 1)) categories, (select count(*) from docs_) || ' documents processed. Top entities: ' || (select string_agg(name, ', ' order by mention_count desc, id) from top_) || '.' as summary")
def g03(spark, d):
    s = store(spark, d)
    x = insights.digest(s["documents"], s["chunks"], s["nodes"])
    return x.select("n_documents", F.array_join(F.transform("categories", lambda c: F.concat_ws("=", c["category"], c["n"].cast("string"))), ",").alias("categories"), "summary")


@query("g04_central_pattern", "select id, centrality from (select id, round(count(*) / ((select count(*) from nodes_) - 1.0::double), 6) centrality from (select source id from arcs_ union all select target from arcs_) group by 1 order by 2 desc, 1 limit 5) where centrality > 0.1")
def g04(spark, d):
    s = store(spark, d)
    return insights.central_pattern(s["nodes"], s["edges"]).select("id", "centrality")


@query("g05_cluster_pattern", "select min(c_custkey) component, count(*) size from customer group by c_nationkey having count(*) >= 3 order by size desc, component limit 5")
def g05(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_nationkey")
    e = c.join(c.groupBy("c_nationkey").agg(F.min("id").alias("target")), "c_nationkey").select(F.col("id").alias("source"), "target")
    return insights.cluster_pattern(c, e).select("component", "size")


@query("g06_insight_log", "select sha256('event|' || event_type || '|' || event_id) id, event_type as title, ts as created_at from events order by ts desc, id desc limit 500")
def g06(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("title"), F.col("event_id").cast("string").alias("description"), F.array("event_type").alias("names"), "ts")
    rows = insights.insight_rows(e, "event", F.col("ts"))
    # half of them are in the log before, in two parts
    log = insights.add_insights(insights.add_insights(rows.limit(0), rows.where(F.col("created_at") < "2024-01-10")), rows.where(F.col("title") == "error"))
    return insights.add_insights(log, rows).select("id", "title", "created_at")


@query("g07_topic_counts", "select time_bucket(interval 7 days, ts, timestamp '1970-01-01') window_start, event_type topic, count(*) n, count(distinct user_id) n_documents from events group by 1, 2")
def g07(spark, d):
    return insights.topic_counts(read(spark, d, "events"), "event_type", "user_id").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
