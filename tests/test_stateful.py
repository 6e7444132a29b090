"""Streams with state: replaced versions, watched folders, timed retries, slots and digests."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import extract
from mnemoframe.operators import chunking, ingest
from mnemoframe.streaming import digests, events as ev, memory, stateful, watch

DOC = "document_id string, source_uri string, checksum string, ts timestamp, text string, deleted boolean"


def doc(uri, text, day, deleted=False):
    return (uri, uri, str(hash(text)), datetime.datetime(2024, 1, day), text, deleted)


def handler(root, seen=None):
    def refresh(added, removed, batch):
        seen.append((batch, sorted(r.chunk_id for r in added.collect()), sorted(r.chunk_id for r in removed.collect())))

    mentions = lambda c: extract.extract_patterns(c, text="content").drop("source")
    return memory.memory_batch(root, lambda b: chunking.chunk_fixed(b, 100, 10), mentions, True, None if seen is None else refresh)


def state(spark, root):
    chunks, nodes, edges = memory.read_memory(spark, root)
    return sorted((r.chunk_id, r.content) for r in chunks.collect()), sorted((r.name, r.mention_count, r.last_seen.day) for r in nodes.collect()), edges.count()


def test_a_new_version_withdraws_the_old_one(spark, tmp_path):
    root, seen = str(tmp_path / "m"), []
    handle = handler(root, seen)
    assert state(spark, root) == ([], [], 0)
    handle(spark.createDataFrame([doc("u", "old text a@b.com", 1), doc("v", "keeps k@l.com a@b.com", 1), doc("w", "goes z@z.com", 1)], DOC), 0)
    second = spark.createDataFrame([doc("u", "first try", 2), doc("u", "new text c@d.com", 3), doc("v", "keeps k@l.com a@b.com", 3), doc("w", "", 3, True), doc("x", "", 3, True), (None,) * 6], DOC)
    handle(second, 1)
    want = ([("u-0", "new text c@d.com"), ("v-0", "keeps k@l.com a@b.com")], [("a@b.com", 1, 1), ("c@d.com", 1, 3), ("k@l.com", 1, 1)], 0)
    assert state(spark, root) == want
    assert [s[1:] for s in seen] == [(["u-0", "v-0", "w-0"], []), (["u-0"], ["u-0", "w-0"])]
    handle(second, 1)  # run again after a failure
    assert state(spark, root) == want
    memory.compact(spark, root, str(tmp_path / "c"))
    assert state(spark, str(tmp_path / "c")) == want
    # a batch that did not get as far as its log is not seen
    handle(spark.createDataFrame([doc("u", "third e@f.com", 4)], DOC), 2)
    os.rename(f"{root}/log/batch=2", f"{root}/away")
    assert state(spark, root) == want


def test_versions_over_a_stream_equal_the_last_ones(spark, tmp_path):
    rows = [doc(f"{'abcdefgh'[k % 8]}{k}", f"text {k} v{v} mail{(k * v) % 5}@x.org mail{k % 3}@y.org", v + 1, v == 2 and k % 4 == 0) for v in range(3) for k in range(16) if v == 0 or k % (v + 1) == 0]
    root, handle = str(tmp_path / "m"), handler(str(tmp_path / "m"))
    for day in range(1, 4):
        spark.createDataFrame([r for r in rows if r[3].day == day], DOC).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(DOC).parquet(str(tmp_path / "in"))
        ev.ingest_stream(stream, handle, str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "ck")).awaitTermination(120)
    last = {r[1]: r for r in sorted(rows, key=lambda r: r[3])}
    batch = str(tmp_path / "b")
    handler(batch)(spark.createDataFrame([r for r in last.values() if not r[5]], DOC), 0)
    assert state(spark, root) == state(spark, batch) and len(last) > len(state(spark, root)[0]) > 5


def kinds(spark, root, batch):
    return sorted((r.change, os.path.basename(r.path), r.old_path and os.path.basename(r.old_path)) for r in watch.read_changes(spark, root).where(F.col("batch") == batch).collect())


def test_watched_folder_sees_four_kinds(spark, tmp_path):
    folder, root = tmp_path / "w", str(tmp_path / "r")
    (folder / "deep").mkdir(parents=True)
    for name, text in (("a.txt", "one"), ("b.txt", "two"), ("deep/c.txt", "three"), ("d.txt", "four"), ("e[1] %20.txt", "five"), ("skip.exe", "no")):
        (folder / name).write_text(text)
    gate = lambda f: f.where(~F.col("path").endswith(".exe"))
    watch.watch_changes(spark, [str(folder)], root, gate).awaitTermination()
    assert [k[0] for k in kinds(spark, root, 0)] == ["created"] * 5
    time.sleep(1.1)
    (folder / "a.txt").write_text("one more")
    (folder / "b.txt").unlink()
    (folder / "deep/c.txt").rename(folder / "moved.txt")
    (folder / "d.txt").write_text("four")  # touched, but the same
    (folder / "new.txt").write_text("six")
    watch.watch_changes(spark, [str(folder)], root, gate).awaitTermination()  # a new query from the checkpoint
    assert kinds(spark, root, 1) == [("created", "new.txt", None), ("deleted", "b.txt", None), ("modified", "a.txt", None), ("moved", "moved.txt", "c.txt")]
    watch.watch_changes(spark, [str(folder)], root, gate).awaitTermination()
    assert kinds(spark, root, 2) == []
    base = str(tmp_path / "base")
    watch.watch_changes(spark, [str(folder)], base, gate, baseline=True).awaitTermination()
    assert kinds(spark, base, 0) == []


def test_failing_events_are_tried_again_and_drained(spark, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")

    def fails(payload, tried):
        if payload == "raises":
            raise RuntimeError("broken")
        return None if tried > int(payload) else "not yet"

    spark.createDataFrame([(1, "0"), (2, "1"), (3, "9"), (4, "raises"), (None, "0")], "event_id long, payload string").coalesce(1).write.parquet(source)

    def run(longest, until):
        tries = stateful.retry_stream(spark.readStream.schema("event_id long, payload string").parquet(source), fails, 3, longest)
        q = tries.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", check).trigger(processingTime="300 milliseconds").start()
        deadline = time.time() + 90
        rows = []
        while time.time() < deadline and not until(rows):
            time.sleep(0.5)
            rows = spark.read.schema("event_id long, attempts int, outcome string, error string").parquet(out).collect() if os.path.isdir(out) else []
        q.stop()
        return sorted((r.event_id, r.attempts, r.outcome, r.error) for r in rows)

    done = run(1, lambda rows: sum(r.outcome != "retry" for r in rows) == 4)
    broken = "RuntimeError: broken"
    assert done == [(1, 1, "done", None), (2, 1, "retry", "not yet"), (2, 2, "done", None), (3, 1, "retry", "not yet"), (3, 2, "retry", "not yet"), (3, 3, "dead_letter", "not yet"), (4, 1, "retry", broken), (4, 2, "retry", broken), (4, 3, "dead_letter", broken)]
    spark.createDataFrame([(7, "1"), (8, "9")], "event_id long, payload string").coalesce(1).write.mode("append").parquet(source)
    run(3600, lambda rows: sum(r.event_id in (7, 8) for r in rows) == 2)
    assert sorted((r.event_id, r.tried) for r in stateful.waiting_events(spark, check).collect()) == [(7, 1), (8, 1)]
    left = sorted((r.event_id, r.attempts, r.outcome) for r in stateful.drain_waiting(spark, check, fails).collect())
    assert left == [(7, 2, "done"), (8, 2, "retry"), (8, 3, "dead_letter")]


def test_slots_of_a_stream_equal_the_closed_form(spark, tmp_path):
    rows = [(i, i % 3, datetime.datetime(2024, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=7 * i + (i * 13) % 5)) for i in range(90)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[2]), "event_id long, q long, ts timestamp")
    for k in range(3):
        df.where(F.col("event_id").between(30 * k, 30 * k + 29)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.1)
    for key, name in (("q", "a"), (None, "b")):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = ev.drain(stateful.slot_stream(stream, 6, key=key), str(tmp_path / name), str(tmp_path / f"ck{name}"))
        want = ingest.token_slots(df, 6, key=key)
        assert sorted((r.tie, r.slot_us) for r in got.collect()) == sorted((r.event_id, r.slot_us) for r in want.collect())


def test_changes_without_path_or_time_are_kept(spark, tmp_path):
    rows = [("a", "modified", "1", None), (None, "modified", "2", 5), ("b", "modified", "3", 9), ("a", "modified", "1", 10), ("a", "modified", "4", 11), (None, "deleted", None, 12), (None, "deleted", None, 13), ("c", "deleted", None, None)]
    df = spark.createDataFrame(rows, "path string, event_type string, checksum string, s long").selectExpr("path", "event_type", "checksum", "timestamp_seconds(s) ts")
    table = sorted(map(str, ev.dedupe_events(df).collect()))
    assert len(table) == 5
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ev.dedupe_events(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    assert sorted(map(str, ev.drain(stream, str(tmp_path / "out"), str(tmp_path / "ck")).collect())) == table


@pytest.mark.parametrize("streaming", [False, True])
def test_digests_of_windows(spark, tmp_path, streaming):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = [(at(1), "x", "p"), (at(2), "x", "q"), (at(3), "y", "p"), (at(3), "z", "r"), (at(4), None, "p"), (at(7), "x", None), (at(30), "w", "p")]
    df = spark.createDataFrame(rows, "ts timestamp, entity string, category string")
    if streaming:
        df.coalesce(1).write.parquet(str(tmp_path / "in"))
        digests.digest_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "d"), top=2).awaitTermination()
        found, central, groups = (spark.read.parquet(str(tmp_path / "d" / t)) for t in ("digests", "central", "clusters"))
    else:
        counts = digests.window_counts(df)
        found, central, groups = digests.digests(counts, 2), digests.central(counts), digests.clusters(counts)
    got = {r.window_start.hour + 24 * (r.window_start.day - 1): (r.n_mentions, r.top_entities, [tuple(c) for c in r.categories or []]) for r in found.collect()}
    want = {0: (5, ["x", "y"], [("p", 3), ("q", 1), ("r", 1)]), 6: (1, ["x"], [])}
    assert got == (want if streaming else want | {30: (1, ["w"], [("p", 1)])})
    first = [r for r in central.collect() if r.window_start == at(0)]
    assert {(r.id, r.degree) for r in first} == {("c:p", 2), ("e:x", 2), ("c:q", 1), ("c:r", 1), ("e:y", 1)}
    assert [(r.component, r["size"]) for r in groups.collect() if r.window_start == at(0)] == [("c:p", 4)]
