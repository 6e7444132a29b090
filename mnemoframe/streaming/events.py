"""Streams of file events and counters (H1-H8). Batch twins are in ``operators.ingest``."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_CHANGES = "path string, change string, checksum string, ts timestamp"


def _content_changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Events of one path against the checksum it had; ties in time go by checksum."""
    held = state.get[0] if state.exists else None
    out = []
    rows = pd.concat(list(batches)).sort_values(["ts", "event_type", "checksum"], na_position="first")
    for r in rows.itertuples(index=False):
        if r.event_type == "deleted":
            if held is not None:
                out.append((key[0], "deleted", held, r.ts))
            held = None
        elif r.checksum != held:
            out.append((key[0], "created" if held is None else "modified", r.checksum, r.ts))
            held = r.checksum
    if held is None:
        if state.exists:
            state.remove()
    else:
        state.update((held,))
    yield pd.DataFrame(out, columns=["path", "change", "checksum", "ts"])


def dedupe_events(events: DataFrame) -> DataFrame:
    """Real changes among file events ``path, event_type, checksum, ts``.

    An event whose checksum the path already has is dropped, created and modified are told apart by what is known, and
    deletions of unknown paths are ignored. State is one checksum for each path that exists. Works on streams and tables.
    Events without a path are those of one path, null; events without a time come before all others of their path.
    """
    rows = events.select("path", "event_type", "checksum", F.col("ts").cast("timestamp").alias("ts"))
    if events.isStreaming:
        return rows.groupBy("path").applyInPandasWithState(_content_changes, _CHANGES, "checksum string", "append", GroupStateTimeout.NoTimeout)

    # a path's rows are compared within a day, and days with the last state of the day before, so no task holds a whole path
    state = F.when(F.col("event_type") != "deleted", F.col("checksum"))
    days = rows.select("*", F.date_trunc("day", "ts").alias("day"), state.alias("state"))
    order = F.struct("ts", "event_type", "checksum")
    ends = days.groupBy("path", "day").agg(F.max_by("state", order).alias("end"))
    carried = ends.select(F.col("path").alias("p"), F.col("day").alias("d"), F.lag("end").over(W.partitionBy("path").orderBy("day")).alias("carried"))
    here = W.partitionBy("path", "day").orderBy("ts", "event_type", "checksum")
    placed = days.withColumn("r", F.row_number().over(here)).withColumn("prior", F.lag("state").over(here)).join(carried, F.col("path").eqNullSafe(F.col("p")) & F.col("day").eqNullSafe(F.col("d")))
    held = placed.withColumn("held", F.when(F.col("r") == 1, F.col("carried")).otherwise(F.col("prior")))
    gone = F.col("event_type") == "deleted"
    real = held.where(F.when(gone, F.col("held").isNotNull()).otherwise(~F.col("checksum").eqNullSafe(F.col("held"))))
    change = F.when(gone, "deleted").when(F.col("held").isNull(), "created").otherwise("modified")
    return real.select("path", change.alias("change"), F.when(gone, F.col("held")).otherwise(F.col("checksum")).alias("checksum"), "ts")


def _allow(n: int, seconds: float) -> Callable:
    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        passed = []
        for t in rows["ts"].astype("int64") // 1000 if str(rows["ts"].dtype).endswith("ns]") else rows["ts"].astype("int64"):
            held = [x for x in held if t - x < seconds * 1e6]
            passed.append(len(held) < n)
            if passed[-1]:
                held.append(int(t))
        state.update((held,))
        yield pd.DataFrame({"event_id": rows["event_id"], "key": key[0], "ts": rows["ts"], "allowed": passed})

    return work


def rate_limit(events: DataFrame, key: str, n: int, seconds: float) -> DataFrame:
    """``event_id, key, ts, allowed``: an event passes if fewer than ``n`` passed in the ``seconds`` before it.

    Only events that passed count, so the rule is sequential within a key; a key's state is at most ``n`` times. On
    tables a key's events stream through one task in order; none is held but those ``n``. Rows without a key are left out.
    """
    rows = events.select("event_id", F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    schema = f"event_id long, key {dict(rows.dtypes)['key']}, ts timestamp, allowed boolean"
    work = _allow(n, seconds)
    if events.isStreaming:
        return rows.groupBy("key").applyInPandasWithState(work, schema, "times array<long>", "append", GroupStateTimeout.NoTimeout)

    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by key and time, so one key's last times are all that is held
        now, held = None, deque()
        for pdf in batches:
            allowed = []
            for k, t in zip(pdf["key"], pdf["us"].tolist(), strict=True):
                if k != now:
                    now, held = k, deque()
                while held and t - held[0] >= seconds * 1e6:
                    held.popleft()
                allowed.append(len(held) < n)
                if allowed[-1]:
                    held.append(t)
            yield pdf.drop(columns="us").assign(allowed=allowed)

    dealt = rows.where(F.col("key").isNotNull()).withColumn("us", F.unix_micros("ts")).repartition("key").sortWithinPartitions("key", "ts", "event_id")
    return dealt.mapInPandas(passing, schema)


def windowed_counters(events: DataFrame, window: str = "6 hours", watermark: str = "1 hour", kind: str = "event_type") -> DataFrame:
    """``window_start, kind, n, total`` of events; on a stream, windows are given out once they are closed."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col(kind).alias("kind"), "value")
    if events.isStreaming:
        rows = rows.withWatermark("ts", watermark)
    return rows.groupBy(F.window("ts", window).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "kind", "n", "total")


def drop_repeated(events: DataFrame, keys: list[str], watermark: str = "1 hour") -> DataFrame:
    """Events once for each key; on a stream within the watermark, so that state stays bounded."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def ingest_stream(texts: DataFrame, handle: Callable[[DataFrame, int], DataFrame], sink: str, dead: str, checkpoint: str):
    """Runs ``handle(batch, batch_id)`` on every micro-batch and writes its rows under ``sink/batch_id=N``.

    A batch that is run again after a failure overwrites its own folder, so rows are never doubled. Rows that ``handle``
    marks with an ``error`` go to the dead-letter folder instead. All waiting input is read, then the query ends.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = handle(batch, batch_id)
        bad = F.col("error").isNotNull() if "error" in done.columns else F.lit(False)
        done.where(~bad).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        if "error" in done.columns:
            done.where(bad).write.mode("overwrite").json(f"{dead}/batch_id={batch_id}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_RETRY = "event_id long, attempts int, outcome string, due timestamp"


def _retries(most: int, longest: int) -> Callable:
    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tried = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("seq")
        ids = [0] * len(rows) if key[0] < 0 else rows["event_id"].tolist()
        attempts, outcomes = [], []
        for i, failed in zip(ids, rows["failed"].tolist(), strict=True):
            n = tried.pop(i, 0) + 1
            attempts.append(n)
            outcomes.append("done" if not failed else "dead_letter" if n >= most else "retry")
            if outcomes[-1] == "retry":
                tried[i] = n
        if tried:
            state.update((list(tried), list(tried.values())))
        elif state.exists:
            state.remove()
        waits = pd.to_timedelta([min(2**n, longest) for n in attempts], unit="s")
        due = (rows["ts"].reset_index(drop=True) + waits).where(pd.Series(outcomes) == "retry")
        yield pd.DataFrame({"event_id": pd.Series([None] * len(ids) if key[0] < 0 else ids, dtype="Int64"), "attempts": attempts, "outcome": outcomes, "due": due})

    return work


def retry_outcomes(attempts: DataFrame, most: int = 3, longest: int = 30, groups: int = 1024) -> DataFrame:
    """``event_id, attempts, outcome, due`` of a stream of tries ``event_id, seq, failed, ts``: done, retry, or dead_letter.

    A retry is due 2, 4, ... seconds after its try, ``longest`` at most (null where tries have no ``ts``). Events share
    ``groups`` states by a hash, each with the waiting events alone, so a call in Python serves many events; a stream keeps
    its number of groups as long as its checkpoint. Tries without an event are those of one event, null.
    """
    ts = F.col("ts").cast("timestamp") if "ts" in attempts.columns else F.lit(None).cast("timestamp")
    group = F.when(F.col("event_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("event_id"), F.lit(groups)))
    rows = attempts.select("event_id", "seq", "failed", ts.alias("ts"), group.alias("group"))
    return rows.groupBy("group").applyInPandasWithState(_retries(most, longest), _RETRY, "ids array<long>, attempts array<int>", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that waits, then reads what it wrote below ``path``.

    ``append`` keeps a folder for each batch, so a batch that is run again replaces itself; ``complete`` keeps the last
    result alone.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}" if mode == "append" else path)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path).select(stream.columns)
