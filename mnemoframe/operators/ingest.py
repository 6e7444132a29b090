"""Change detection and ingestion as set operations on tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mnemoframe.functions.responses import json_block
from mnemoframe.functions.text import normalise
from mnemoframe.operators.chunking import chunk_documents, chunk_recursive
from mnemoframe.scratch import written


def diff_snapshots(old: DataFrame, new: DataFrame, first_run: bool | None = None, detect_moves: bool = False, allowed: Column | None = None) -> DataFrame:
    """``path, change, checksum, old_path`` between two snapshots ``path, checksum``; unchanged paths have no row.

    On a first run (an empty old snapshot, unless stated) nothing is reported. ``allowed`` filters deleted paths.
    With ``detect_moves``, a deleted and a created path with one checksum become one ``moved`` row; of several with one
    checksum, the paths are matched in order.
    """
    if first_run is None:
        first_run = not old.limit(1).count()
    o, n = old.select("path", F.col("checksum").alias("was")), new.select("path", F.col("checksum").alias("is"))
    both = o.join(n, "path", "full_outer")
    change = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "deleted").when(F.col("was") != F.col("is"), "modified")
    out = both.select("path", change.alias("change"), F.coalesce("is", "was").alias("checksum"), F.lit(None).cast("string").alias("old_path")).where(F.col("change").isNotNull() & ~F.lit(first_run))
    if allowed is not None:
        out = out.where((F.col("change") != "deleted") | allowed)
    if not detect_moves:
        return out
    w = W.partitionBy("change", "checksum").orderBy("path")
    turn = out.where(F.col("change").isin("created", "deleted")).withColumn("r", F.row_number().over(w))
    made, lost = turn.where("change = 'created'").select("path", "checksum", "r"), turn.where("change = 'deleted'").select(F.col("path").alias("old_path"), "checksum", "r")
    moved = made.join(lost, ["checksum", "r"]).select("path", F.lit("moved").alias("change"), "checksum", "old_path")
    used = moved.select("path", F.lit("created").alias("change")).unionByName(moved.select(F.col("old_path").alias("path"), F.lit("deleted").alias("change")))
    return out.join(used, ["path", "change"], "left_anti").select("path", "change", "checksum", "old_path").unionByName(moved)


def upsert(old: DataFrame, batch: DataFrame, key: str = "source_uri", version: str = "checksum") -> tuple[DataFrame, DataFrame]:
    """The new table, and the rows of ``batch`` that were taken: new keys, and keys with another version.

    Keys decide, not contents: equal texts under two keys both stay. Of repeated keys in a batch the largest version counts,
    of equal versions the row with the largest hash of all columns.
    """
    each = F.struct(*(F.col(f"`{c}`") for c in batch.columns))
    rows = batch.select(F.col(key).alias("k"), F.struct(F.col(version).alias("v"), F.xxhash64(each).alias("h"), each.alias("row")).alias("x"))
    once = rows.groupBy("k").agg(F.max_by("x.row", F.struct("x.v", "x.h")).alias("row")).select("row.*")
    same = old.select(key, version).distinct()
    taken = once.join(same, (once[key] == same[key]) & once[version].eqNullSafe(same[version]), "left_anti")
    return old.join(taken.select(key), key, "left_anti").unionByName(taken, allowMissingColumns=True), taken


def with_status(docs: DataFrame, chunked: DataFrame) -> DataFrame:
    """Documents with ``status`` (processed once they have chunks, else processing) and ``enrichment_status`` pending."""
    done = chunked.select(F.col("document_id").alias("k")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("document_id").alias("id")).join(done, F.col("id") == F.col("k"), "left")
    status = F.when(F.col("k").isNotNull(), "processed").otherwise("processing")
    return rows.select(F.col("row").withField("status", status).withField("enrichment_status", F.lit("pending")).alias("row")).select("row.*")


def build_nodes(mentions: DataFrame, relations: DataFrame, mentions_only: bool = False) -> DataFrame:
    """``id, name, type, mention_count, first_seen, last_seen`` of entities, one for each lower-case name.

    ``mentions(chunk_id, pos, name, type, ts)``; the earliest mention gives name and type. Every mention counts, and, unless
    ``mentions_only``, every relation end (``relations(source, target)``).
    """
    m = mentions.withColumn("lname", F.lower(F.trim("name")))
    first = F.struct("ts", "chunk_id", "pos", "name")
    per = m.groupBy("lname").agg(F.min_by("name", first).alias("name"), F.min_by("type", first).alias("type"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    ends = relations.select(F.lower(F.trim("source")).alias("lname")).unionAll(relations.select(F.lower(F.trim("target")).alias("lname"))).groupBy("lname").agg(F.count(F.lit(1)).alias("ends"))
    n = F.col("n") if mentions_only else F.col("n") + F.coalesce("ends", F.lit(0))
    return per.join(ends, "lname", "left").select(F.sha2("lname", 256).alias("id"), "name", "type", n.alias("mention_count"), "first_seen", "last_seen")


def build_node_chunks(mentions: DataFrame) -> DataFrame:
    return mentions.select(F.sha2(F.lower(F.trim("name")), 256).alias("node_id"), "chunk_id").distinct()


def build_edges(relations: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """``id, source, target, relationship, source_chunk, created_at``: the first row of each triple; ``prior`` edges stay."""
    key = lambda c: F.sha2(F.lower(F.trim(c)), 256)
    rows = relations.select(key("source").alias("source"), key("target").alias("target"), "relationship", F.col("chunk_id").alias("source_chunk"), F.col("ts").alias("created_at"))
    first = W.partitionBy("source", "target", "relationship").orderBy("created_at", "source_chunk")
    new = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    if prior is not None:
        new = new.join(prior.select("source", "target", "relationship"), ["source", "target", "relationship"], "left_anti")
    new = new.select(F.sha2(F.concat_ws("|", "source", "target", "relationship"), 256).alias("id"), "source", "target", "relationship", "source_chunk", "created_at")
    return new if prior is None else prior.unionByName(new)


def delete_documents(store: Mapping[str, DataFrame], uris: DataFrame) -> dict[str, DataFrame]:
    """The store without documents of ``uris.source_uri``, their chunks, vectors and chunk links; the graph stays."""
    gone = store["documents"].join(uris.select("source_uri").distinct(), "source_uri", "left_semi").select("document_id")
    lost = store["chunks"].join(gone, "document_id", "left_semi").select("chunk_id")
    out = dict(store) | {"documents": store["documents"].join(gone, "document_id", "left_anti"), "chunks": store["chunks"].join(gone, "document_id", "left_anti"), "node_chunks": store["node_chunks"].join(lost, "chunk_id", "left_anti")}
    if "vectors" in store:
        out["vectors"] = store["vectors"].join(lost, "chunk_id", "left_anti")
    return out


def enrichment_input(chunks: DataFrame, first: int = 3, longest: int = 3000) -> DataFrame:
    """``document_id, prompt_text``: the first chunks of each document, joined and cut."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n")
    return chunks.where(F.col("chunk_index") < first).groupBy("document_id").agg(F.left(joined, F.lit(longest)).alias("prompt_text"))


def apply_enrichment(docs: DataFrame, responses: DataFrame) -> DataFrame:
    """Documents with ``summary, category, action_items`` and ``enrichment_status`` from ``responses(document_id, response)``.

    A response with a JSON block completes a document, one without fails it, and no response defers it.
    """
    r = responses.select("document_id", F.col("response"), json_block("response", "summary string, category string, action_items array<string>").alias("j"), F.col("response").rlike(r"(?s)\{.*\}").alias("ok"))
    j = docs.drop("enrichment_status", "summary", "category", "action_items").join(r, "document_id", "left")
    status = F.when(F.col("response").isNull(), "deferred").when(F.col("ok"), "completed").otherwise("failed")
    none = F.array().cast("array<string>")
    return j.select(*[c for c in j.columns if c not in ("response", "j", "ok")], F.coalesce("j.summary", F.lit("")).alias("summary"), F.coalesce("j.category", F.lit("")).alias("category"), F.coalesce("j.action_items", none).alias("action_items"), status.alias("enrichment_status"))


def retry_schedule(events: DataFrame, most: int = 3, longest: int = 30) -> DataFrame:
    """Adds ``action`` and ``delay_s`` to failed events by their ``attempts``: 2, 4, ... seconds, then the dead-letter table."""
    again = F.col("attempts") < most
    return events.withColumn("action", F.when(again, "retry").otherwise("dead_letter")).withColumn("delay_s", F.when(again, F.least(F.pow(F.lit(2.0), F.col("attempts")), F.lit(float(longest))).cast("int")))


def token_slots(events: DataFrame, per_minute: float, ts: str = "ts", tie: str = "event_id", key: str | None = None, bucket: str = "hour") -> DataFrame:
    """Adds ``slot_us``: the earliest microsecond, no earlier than its own, that leaves 60 / ``per_minute`` seconds between.

    The recurrence has the closed form n * d + running max of (t - n * d). Both the place n and the running max are made
    within a ``bucket`` of time first and carried from bucket to bucket, one row each, so a queue of all events, or of a
    hot key, is not the work of one task. Without ``key`` there is one queue.
    """
    gap = F.lit(round(60_000_000 / per_minute)).cast("long")
    queue = (F.col(key) if key else F.lit(0)).alias("q")
    rows = events.select(F.struct("*").alias("row"), queue, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.date_trunc(bucket, F.col(ts).cast("timestamp")).alias("b"), F.col(tie).alias("tie"))
    here = W.partitionBy("q", "b").orderBy("us", "tie")
    running = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = rows.withColumn("n", F.row_number().over(here).cast("long")).withColumn("late", F.col("us") - F.col("n") * gap)
    ends = local.groupBy("q", "b").agg(F.count(F.lit(1)).alias("size"), F.max("late").alias("late"))
    # before a bucket stand all events of those before it, so its own lateness counts from there
    before = W.partitionBy("q").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    placed = ends.withColumn("ahead", F.coalesce(F.sum("size").over(before), F.lit(0)))
    carried = placed.withColumn("most", F.max(F.col("late") - F.col("ahead") * gap).over(before)).select(F.col("q").alias("cq"), F.col("b").alias("cb"), "ahead", "most")
    joined = local.withColumn("most_here", F.max("late").over(running)).join(carried, F.col("q").eqNullSafe(F.col("cq")) & F.col("b").eqNullSafe(F.col("cb")))
    most = F.greatest(F.col("most_here") - F.col("ahead") * gap, F.col("most"))
    return joined.select("row.*", ((F.col("ahead") + F.col("n")) * gap + most).alias("slot_us"))


def ingest_counters(events: DataFrame) -> DataFrame:
    """One row of progress counters over ``status, n_chunks, ts``."""
    of = lambda s: F.count_if(F.col("status") == s)
    return events.agg(of("queued").alias("queued"), of("processed").alias("processed"), of("failed").alias("failed"), of("skipped").alias("skipped"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.max("ts").alias("last_scan"))


def intake(texts: DataFrame, size: int = 500, overlap: int = 100, text: str = "text", doc_id: str = "document_id") -> DataFrame:
    """Texts normalised and cut into chunks; what is empty then has no rows."""
    clean = texts.select(doc_id, normalise(text).alias("clean")).where(F.col("clean") != "")
    return chunk_recursive(clean, size, overlap, doc_id, "clean")


def intake_files(files: DataFrame, parsers: Mapping | None = None, size: int = 500, overlap: int = 100) -> tuple[DataFrame, DataFrame]:
    """Files (``path, content``) parsed by their suffix, normalised and cut: chunk records, and ``path, error`` of the others.

    Records are those of ``chunking.chunk_documents``: the title is the file's name without suffix, the page is 1. A file
    whose text is blank has neither.
    """
    from mnemoframe.sources.parsing import PARSERS, parse_files

    parsed = written(parse_files(files, PARSERS if parsers is None else parsers), "parsed")
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    title = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)
    docs = parsed.where("error is null").select(normalise("text").alias("text"), F.col("path").alias("source"), F.lit(1).alias("page"), title.alias("title"))
    return chunk_documents(docs, size, overlap), parsed.where("error is not null").select("path", "error")
