"""Streaming operators in their batch form over the event table (H), with their SQL; tests run them as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.functions import extract
from mnemoframe.operators import chunking
from mnemoframe.plans import texts
from mnemoframe.plans.store import read
from mnemoframe.plans.texts import PATTERN_SQL
from mnemoframe.scratch import exists, new_path
from mnemoframe.streaming import digests, events as ev, memory, stateful, watch

CATALOG: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        CATALOG[name] = (f, sql)
        return f

    return add


def file_events(spark, d):
    """Users are paths, the value in tens is the content, and errors are deletions."""
    e = read(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), kind.alias("event_type"), F.floor(F.col("value") / 10).cast("string").alias("checksum"), "ts")


_EVENTS = "e_ as (select 'u' || user_id as path, event_type = 'error' as gone, case when event_type = 'error' then null else cast(cast(floor(value / 10) as bigint) as varchar) end as checksum, ts from events)"


@query("h01_dedupe_events", f"with {_EVENTS}, p_ as (select *, lag(checksum) over (partition by path order by ts) as before from e_) select path, case when gone then 'deleted' when before is null then 'created' else 'modified' end as change, coalesce(checksum, before) as checksum, ts from p_ where (gone and before is not null) or (not gone and checksum is distinct from before)")
def h01(spark, d):
    return ev.dedupe_events(file_events(spark, d)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _stream(spark, df):
    """A table derived from the given ones, written and read again as a stream of its files."""
    path = new_path(spark, "stream")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


def _drained(spark, stream, mode="append"):
    return ev.drain(stream, new_path(spark, "drained"), new_path(spark, "checkpoint"), mode)


@query("h01_dedupe_stream", CATALOG["h01_dedupe_events"][1])
def h01b(spark, d):
    """The same changes found by a stream, whose files hold the paths whole and in order."""
    ordered = file_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).repartition("path").sortWithinPartitions("path", "ts")
    return _drained(spark, ev.dedupe_events(_stream(spark, ordered))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("h03_retries", "with t_ as (select event_id, seq, ts + to_seconds(seq * 60) as ts, seq < 3 - (user_id % 4) or user_id % 4 = 0 as failed from events, unnest([1, 2, 3]) s(seq) where seq <= greatest(1, 3 - (user_id % 4)) or user_id % 4 = 0) select event_id, cast(seq as int) attempts, case when not failed then 'done' when seq >= 3 then 'dead_letter' else 'retry' end as outcome, case when failed and seq < 3 then ts + to_seconds(cast(power(2, seq) as bigint)) end as due from t_")
def h03(spark, d):
    """Every event is tried until it is done, as often as its user's number says; some never are."""
    k = F.col("user_id") % 4
    tries = read(spark, d, "events").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where((F.col("seq") <= F.greatest(F.lit(1), 3 - k)) | (k == 0))
    rows = tries.select("event_id", F.col("seq").cast("long").alias("seq"), ((F.col("seq") < 3 - k) | (k == 0)).alias("failed"), (F.col("ts").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("seq"), F.lit(0))).alias("ts"))
    out = _drained(spark, ev.retry_outcomes(_stream(spark, rows.repartition("event_id").sortWithinPartitions("event_id", "seq"))))
    return out.withColumn("due", F.col("due").cast("timestamp_ntz"))


@query("h05_rate_limit", "with recursive e_ as (select event_id, user_id, ts, epoch_us(ts) us, row_number() over (partition by user_id order by ts, event_id) r from events), s_ as (select event_id, user_id, ts, r, true as allowed, [us] as held from e_ where r = 1 union all select event_id, user_id, ts, r, len(kept) < 3, case when len(kept) < 3 then list_append(kept, us) else kept end from (select e.*, list_filter(s_.held, lambda x: e.us - x < 3600000000) as kept from s_ join e_ e on e.user_id = s_.user_id and e.r = s_.r + 1)) select event_id, user_id as key, ts, allowed from s_")
def h05(spark, d):
    return ev.rate_limit(read(spark, d, "events"), "user_id", 3, 3600).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("h07_interval_digest", "select time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as window_start, event_type as kind, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def h07(spark, d):
    x = ev.windowed_counters(read(spark, d, "events"))
    return x.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "kind", "n", F.round("total", 4).alias("total"))


def _parts(spark, df, by, n: int) -> str:
    """A folder with the rows of ``df`` as files that arrive one after the other, those with ``by`` = 0 first."""
    path = new_path(spark, "arriving")
    for k in range(n):
        df.where(by == k).coalesce(1).write.mode("append").parquet(path)
    return path


def _read_parts(spark, df, path: str):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


# Events come in four files by time, but every fiftieth of the first three comes in the last, too late for most windows.
_ARRIVING = "t_ as (select min(ts) lo, max(ts) hi from events), a_ as (select e.*, case when event_id % 50 = 0 then 3 else least(3, cast(floor(4 * (epoch(ts) - epoch(lo)) / (epoch(hi) - epoch(lo))) as int)) end as part from events e, t_)"


def _arriving(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    part = F.floor(4 * (F.col("ts").cast("double") - lo.timestamp()) / (hi.timestamp() - lo.timestamp()))
    return e, F.when(F.col("event_id") % 50 == 0, 3).otherwise(F.least(F.lit(3), part))


# A row counts unless its window had closed when the file before its own was read (late rows are told by the watermark of
# the batch before); a window is given out once it closes.
_LATE = f"with {_ARRIVING}, w_ as (select p, (select max(ts) from a_ where part < p - 1) - interval 1 hour as mark from (values (0), (1), (2), (3)) v(p)), end_ as (select max(ts) - interval 1 hour as mark from a_), r_ as (select a_.*, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as window_start from a_), in_ as (select r_.* from r_ join w_ on p = part where mark is null or window_start + interval 6 hours > mark)"


@query("h08_closed_windows", f"{_LATE} select window_start, event_type as kind, count(*) n, round(sum(value), 4) total from in_, end_ where window_start + interval 6 hours <= end_.mark group by 1, 2")
def h08c(spark, d):
    """Counters of windows as they close: rows that come after that are dropped, windows that are open are not given out."""
    e, part = _arriving(spark, d)
    rows = e.select("event_id", "event_type", "ts", "value")
    x = _drained(spark, ev.windowed_counters(_read_parts(spark, rows, _parts(spark, rows, part, 4))))
    return x.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "kind", "n", F.round("total", 4).alias("total"))


@query("h07_window_digests", f"{_LATE}, c_ as (select window_start, 'u' || user_id as entity, event_type as category, count(*) n from in_, end_ where window_start + interval 6 hours <= end_.mark group by 1, 2, 3), top_ as (select window_start, string_agg(entity, ',' order by r) as top_entities from (select window_start, entity, row_number() over (partition by window_start order by sum(n) desc, entity) r from c_ group by 1, 2) where r <= 3 group by 1), cat_ as (select window_start, string_agg(category || '=' || n, ',' order by category) categories from (select window_start, category, sum(n) n from c_ group by 1, 2) group by 1), g_ as (select distinct window_start, 'e:' || entity a, 'c:' || category b from c_), deg_ as (select window_start, id, count(*) degree, count(*) over (partition by window_start) nodes from (select window_start, a id from g_ union all select window_start, b from g_) group by 1, 2), cen_ as (select window_start, string_agg(id || ':' || degree, ',' order by r) central from (select *, row_number() over (partition by window_start order by degree desc, id) r from deg_ where degree / greatest(nodes - 1, 1) > 0.1) where r <= 5 group by 1) select window_start, cast(sum(n) as bigint) n_mentions, any_value(categories) categories, any_value(top_entities) top_entities, coalesce(any_value(central), '') central from c_ join top_ using (window_start) join cat_ using (window_start) left join cen_ using (window_start) group by 1")
def h07c(spark, d):
    """A digest of every window that closes on the stream, with the central nodes of its graph."""
    e, part = _arriving(spark, d)
    rows = e.select("ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity"), F.col("event_type").alias("category"), "event_id")
    root = new_path(spark, "digests")
    digests.digest_stream(_read_parts(spark, rows, _parts(spark, rows, part, 4)), root, top=3).awaitTermination()
    found, central = (spark.read.parquet(f"{root}/{t}") for t in ("digests", "central"))
    order = F.struct((-F.col("degree")).alias("n"), "id", "degree")
    named = central.groupBy("window_start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.concat(x["id"], F.lit(":"), x["degree"].cast("string"))), ",").alias("central"))
    cats = F.array_join(F.transform("categories", lambda x: F.concat(x["category"], F.lit("="), x["n"].cast("string"))), ",")
    return found.join(named, "window_start", "left").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_mentions", cats.alias("categories"), F.array_join("top_entities", ",").alias("top_entities"), F.coalesce("central", F.lit("")).alias("central"))


@query("h03_timed_retries", "select event_id, cast(a as int) as attempts, case when a > fails then 'done' when a = 3 then 'dead_letter' else 'retry' end as outcome from (select event_id, user_id % 5 as fails from events where event_type = 'error'), unnest([1, 2, 3]) t(a) where a <= fails + 1")
def h03b(spark, d):
    """Failing events that the stream itself tries again when their time has come: a payload says how often it fails."""
    bad = read(spark, d, "events").where("event_type = 'error'").select("event_id", F.concat(F.col("user_id").cast("string"), F.lit("/"), (F.col("user_id") % 5).cast("string")).alias("payload"))
    root = new_path(spark, "retries")
    tries = stateful.retry_stream(_stream(spark, bad), texts.fails_so_often, most=3, longest=2)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    running = tries.writeStream.foreachBatch(write).option("checkpointLocation", new_path(spark, "checkpoint")).trigger(processingTime="500 milliseconds").start()
    try:
        return _settled(spark, running, root, bad.count())
    finally:
        running.stop()


def _settled(spark, running, root: str, events: int):
    """Waits until every event is done or a dead letter."""
    import time

    for _ in range(1200):
        if running.exception() is not None:
            raise running.exception()
        if exists(spark, root):
            seen = spark.read.schema("event_id long, attempts int, outcome string").parquet(root)
            if seen.where("outcome <> 'retry'").count() >= events:
                return seen.select("event_id", "attempts", "outcome")
        time.sleep(0.5)
    raise TimeoutError("events are still waiting")


@query("h04_slot_stream", "select event_id, epoch_us(ts) as us, n * 2000000 + max(epoch_us(ts) - n * 2000000) over (partition by user_id order by ts, event_id) as slot_us from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events)")
def h04(spark, d):
    """Slots two seconds apart in a queue for each user, with the last slot of each as state, over files in order of time."""
    e = read(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    part = F.floor(3 * (F.col("ts").cast("double") - lo.timestamp()) / (hi.timestamp() + 1 - lo.timestamp()))
    out = _drained(spark, stateful.slot_stream(_read_parts(spark, e, _parts(spark, e, part, 3)), 30, key="user_id"))
    return out.select(F.col("tie").alias("event_id"), "us", "slot_us")


_PIECE = "p_ as (select doc_id || '-' || (i // 400) as chunk_id, doc_id, substr(text, i + 1, 500) as text from (select doc_id, text, unnest(range(0, length(text), 400)) i from documents))"


def _memory(spark, d, versions: int, mentions, mentions_only=True):
    """A memory that took documents in batches: all of them first, then, as a second version, what ``_second`` says."""
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_uri"), "text", "doc_id")
    of = lambda df, ts, gone: df.select("document_id", "source_uri", F.sha2("text", 256).alias("checksum"), F.lit(ts).cast("timestamp").alias("ts"), "text", gone.alias("deleted"))
    root, incoming, checkpoint = new_path(spark, "memory"), new_path(spark, "incoming"), new_path(spark, "checkpoint")
    handle = memory.memory_batch(root, lambda b: chunking.chunk_fixed(b, doc_id="document_id"), mentions, mentions_only)
    first = of(docs, "2024-01-01", F.lit(False))
    again = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("See new@example.org, Newcomer Newsletter. "), F.reverse("text"))).otherwise(F.col("text"))
    second = of(docs.withColumn("text", again), "2024-01-02", F.col("doc_id") % 7 == 0)
    for version in (first, second)[:versions]:
        version.repartition(4).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 4).parquet(incoming)
        ev.ingest_stream(stream, handle, f"{root}/done", f"{root}/dead", checkpoint).awaitTermination()
    return root


@query("h06_micro_batches", f"with {_PIECE}, m_ as ({PATTERN_SQL.replace('doc_id', 'chunk_id').replace('from documents', 'from p_')}) select 'chunks' as kind, cast(doc_id as varchar) as key, count(*) n from p_ group by 2 union all select 'nodes', sha256(lower(name)), count(*) from m_ group by 2")
def h06(spark, d):
    """Documents arrive as files; each batch is cut, its entities are found, and the memory is read back."""
    root = _memory(spark, d, 1, lambda c: extract.extract_patterns(c, text="content").drop("source"))
    chunks, nodes, _ = memory.read_memory(spark, root)
    counted = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("chunks").alias("kind"), F.col("document_id").alias("key"), "n")
    return counted.unionAll(nodes.select(F.lit("nodes"), "id", "mention_count"))


_VERSIONS = "docs2_ as (select doc_id, case when doc_id % 3 = 0 then 'See new@example.org, Newcomer Newsletter. ' || reverse(text) else text end as text from documents where doc_id % 7 <> 0)"


@query("h06_replaced_versions", texts.versions_sql(_VERSIONS, "docs2_"))
def h06b(spark, d):
    """Documents come twice, some changed and some deleted: nothing of an old version is left in chunks, nodes or edges."""
    root = _memory(spark, d, 2, lambda c: extract.extract_named(c, texts._tagger, text="content").drop("source"), False)
    chunks, nodes, edges = memory.read_memory(spark, root)
    out = chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), F.sha2("content", 256).alias("value"))
    out = out.unionAll(nodes.select(F.lit("node"), "id", F.concat_ws("|", F.lower("name"), F.col("mention_count").cast("string"), F.date_format("last_seen", "yyyy-MM-dd"))))
    return out.unionAll(edges.select(F.lit("edge"), F.concat_ws(">", "source", "target", "relationship"), F.date_format("created_at", "yyyy-MM-dd")))


# Forty files, each of the pages with one remainder; then a fourth is rewritten, a fourth removed and a fourth renamed.
@query("a02_watch_changes", "with f_ as (select page_id % 40 as k, sha256(string_agg(html || chr(10), '' order by page_id)) as was, sha256(string_agg(html || '!' || chr(10), '' order by page_id)) as changed from pages where html is not null group by 1), n_ as (select *, 'f' || k || '.txt' as name from f_) select 0::bigint as batch, name, 'created' as change, was as checksum, null as old_name from n_ union all select 1, case when k % 4 = 2 then 'm' || k || '.txt' else name end, ['modified', 'deleted', 'moved'][k % 4 + 1], case when k % 4 = 0 then changed else was end, case when k % 4 = 2 then name end from n_ where k % 4 < 3")
def a02b(spark, d):
    folder, root = new_path(spark, "watched"), new_path(spark, "looks")
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))
    pages = read(spark, d, "pages").where("html is not null").withColumn("k", (F.col("page_id") % 40).cast("int"))
    have = [r.k for r in pages.select("k").distinct().collect()]
    texts.put_files(spark, pages.select("k", "page_id", "html"), folder, {k: f"f{k}.txt" for k in have})
    watch.watch_changes(spark, [folder], root).awaitTermination()
    changed = pages.where("k % 4 = 0").select("k", "page_id", F.concat("html", F.lit("!")).alias("html"))
    texts.put_files(spark, changed, folder, {k: f"f{k}.txt" for k in have if k % 4 == 0})
    texts.move_files(spark, folder, {f"f{k}.txt": None if k % 4 == 1 else f"m{k}.txt" for k in have if k % 4 in (1, 2)})
    watch.watch_changes(spark, [folder], root).awaitTermination()
    name = lambda c: F.substring_index(c, "/", -1)
    return watch.read_changes(spark, root).select("batch", name("path").alias("name"), "change", "checksum", name("old_path").alias("old_name"))


@query("h08_event_counters", "select time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as window_start, event_type as kind, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def h08(spark, d):
    """The counters of a stream, all windows as they stand at its end."""
    rows = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    x = _drained(spark, ev.windowed_counters(_stream(spark, rows)), "complete")
    return x.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "kind", "n", F.round("total", 4).alias("total"))


@query("h08_drop_repeated", "select count(*) n from (select distinct user_id, event_type from events)")
def h08(spark, d):
    return ev.drop_repeated(read(spark, d, "events"), ["user_id", "event_type"]).agg(F.count(F.lit(1)).alias("n"))
