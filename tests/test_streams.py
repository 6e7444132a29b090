"""Streams give the rows of their batch twins."""

import random
import time

from pyspark.sql import functions as F

from mnemoframe.plans.streams import file_events
from mnemoframe.streaming import events as ev


def split(df, path, parts=3):
    """Writes a table as files that a stream reads one by one, in order of time."""
    lo, hi = df.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    step = (hi - lo) // parts + 1
    for k in range(parts):
        df.where(F.floor((F.unix_seconds("ts") - lo) / step) == k).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in order of their times


def run(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_changes_and_rate_limit(spark, small, tmp_path):
    files = file_events(spark, small).withColumn("ts", F.col("ts").cast("timestamp"))
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for name, df, f in (("changes", files, ev.dedupe_events), ("allowed", events, lambda x: ev.rate_limit(x, "user_id", 2, 7200))):
        path = str(tmp_path / name)
        split(df, path)
        got = run(f(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)), spark, name)
        want = f(df)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_rate_limit_is_sequential(spark):
    e = spark.createDataFrame([(i, 1, t) for i, t in enumerate([0, 10, 20, 59, 60, 61, 70, 200])], "event_id long, user_id long, s long").selectExpr("event_id", "user_id", "timestamp_seconds(s) ts")
    held, want = [], []
    for t in [0, 10, 20, 59, 60, 61, 70, 200]:
        held = [x for x in held if t - x < 60]
        want.append(len(held) < 2)
        if want[-1]:
            held.append(t)
    assert [r.allowed for r in ev.rate_limit(e, "user_id", 2, 60).orderBy("event_id").collect()] == want


def test_closed_windows(spark, small, tmp_path):
    df = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    split(df, str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    got = {(r.window_start, r.kind): r.n for r in run(ev.windowed_counters(stream), spark, "windows").collect()}
    want = {(r.window_start, r.kind): r.n for r in ev.windowed_counters(df).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) > 0.8 * len(want)
    once = run(ev.drop_repeated(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), ["event_id"]), spark, "once")
    assert once.count() == df.count()


def test_micro_batches_and_retries(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}" if i % 3 else "") for i in range(9)], "doc_id long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    handle = lambda b, _: b.withColumn("error", F.when(F.col("text") == "", "empty"))
    for _ in range(2):  # the second run has nothing new to do
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ev.ingest_stream(stream, handle, str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6 and spark.read.json(str(tmp_path / "dead")).count() == 3
    tries = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, True), (2, 1, True), (2, 2, False), (3, 1, False)], "event_id long, seq long, failed boolean")
    tries.coalesce(1).write.parquet(str(tmp_path / "tries"))
    got = run(ev.retry_outcomes(spark.readStream.schema(tries.schema).parquet(str(tmp_path / "tries"))), spark, "tries")
    assert sorted((r.event_id, r.attempts, r.outcome) for r in got.collect()) == [(1, 1, "retry"), (1, 2, "retry"), (1, 3, "dead_letter"), (2, 1, "retry"), (2, 2, "done"), (3, 1, "done")]


def test_watch_folder(spark, tmp_path):
    from mnemoframe.sources import files

    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.txt").write_text("one")
    (tmp_path / "w/b.txt").write_text("two")
    seen = run(files.decode_text(files.watch_files(spark, str(tmp_path / "w"))).select("path", "text"), spark, "watched")
    assert sorted(r.text for r in seen.collect()) == ["one", "two"]


def test_retries_of_many_events_share_states(spark, tmp_path):
    """A call in Python serves many events; counts go on over micro-batches, and a null event is one of its own."""
    rng = random.Random(4)
    tries = [(None if k % 40 == 0 else k % 40, seq, rng.random() < 0.7) for seq in range(1, 7) for k in range(40)]
    for seq in range(1, 7):
        spark.createDataFrame([t for t in tries if t[1] == seq], "event_id long, seq long, failed boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "tries"))
    want, tried = [], {}
    for e, _, failed in tries:
        n = tried.pop(e, 0) + 1
        want.append((e, n, "done" if not failed else "dead_letter" if n >= 3 else "retry"))
        if want[-1][2] == "retry":
            tried[e] = n
    stream = spark.readStream.schema("event_id long, seq long, failed boolean").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "tries"))
    outcomes = ev.retry_outcomes(stream, groups=5)
    assert '[group' in outcomes._jdf.queryExecution().analyzed().toString().split("FlatMapGroupsInPandasWithState")[1].split("\n")[0]
    got = run(outcomes, spark, "shared")
    assert sorted(map(str, ((r.event_id, r.attempts, r.outcome) for r in got.collect()))) == sorted(map(str, want))
