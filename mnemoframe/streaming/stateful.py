"""Operators with state and timers of their own (H3, H4). They need the RocksDB state store, which ``use_rocksdb`` sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store of streams that are started from now on, unless the session names one itself."""
    if "RocksDB" not in spark.conf.get(_STORE, ""):
        spark.conf.set(_STORE, _ROCKS)


def delay_ms(tried: int, longest: int) -> int:
    return 1000 * min(2**tried, longest)


class _Retries(StatefulProcessor):
    """Events that failed wait in a list; a timer at the time of each tries them again."""

    def __init__(self, attempt: Callable[[str, int], str | None], most: int, longest: int) -> None:
        self.attempt, self.most, self.longest = attempt, most, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "payload string, tried int, due long")

    def _try(self, key, payload: str, tried: int, now: int, held: list) -> Row:
        try:
            error = self.attempt(payload, tried)
        except Exception as e:  # noqa: BLE001  an attempt may fail in any way
            error = f"{type(e).__name__}: {e}"
        outcome = "done" if error is None else "dead_letter" if tried >= self.most else "retry"
        due = now + delay_ms(tried, self.longest) if outcome == "retry" else None
        if due is not None:
            held.append((payload, tried, due))
            self.handle.registerTimer(due)
        return Row(event_id=key[0], payload=payload, attempts=tried, outcome=outcome, error=error, due_ms=due)

    def _keep(self, held: list) -> None:
        if held:
            self.waiting.put(held)
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        now = timerValues.getCurrentProcessingTimeInMs()
        out = [self._try(key, r.payload, 1, now, held) for r in rows]
        self._keep(held)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        before = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        held = [w for w in before if w[2] > now]
        out = [self._try(key, payload, tried + 1, timerValues.getCurrentProcessingTimeInMs(), held) for payload, tried, due in before if due <= now]
        self._keep(held)
        return iter(out)

    def close(self) -> None:
        pass


_TRIED = "event_id long, payload string, attempts int, outcome string, error string, due_ms long"


def retry_stream(events: DataFrame, attempt: Callable[[str, int], str | None], most: int = 3, longest: int = 30) -> DataFrame:
    """Every try of a stream of events ``event_id, payload``: ``event_id, payload, attempts, outcome, error, due_ms``.

    ``attempt`` gets a payload and the number of the try, and returns an error or None; what it raises is an error. An event that fails is tried again
    by the stream itself, by a timer 2, 4, ... seconds later (``longest`` at most), until it is done or was tried ``most``
    times and is a dead letter. State is the events that wait. Rows without an event_id are left out.
    """
    use_rocksdb(events.sparkSession)
    rows = events.where(F.col("event_id").isNotNull()).select(F.col("event_id").cast("long").alias("event_id"), F.col("payload").cast("string").alias("payload"))
    return rows.groupBy("event_id").transformWithState(_Retries(attempt, most, longest), StructType.fromDDL(_TRIED), "append", "ProcessingTime")


def waiting_events(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``event_id, payload, tried, due_ms`` of the events that a stopped ``retry_stream`` left waiting."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "waiting").load()
    return state.select("key.event_id", "list_element.payload", "list_element.tried", F.col("list_element.due").alias("due_ms"))


def drain_waiting(spark: SparkSession, checkpoint: str, attempt: Callable[[str, int], str | None], most: int = 3) -> DataFrame:
    """The remaining tries of the waiting events, without delays, as one table: what is left when a stream is shut down."""
    schema = _TRIED

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                for tried in range(r.tried + 1, most + 1):
                    try:
                        error = attempt(r.payload, tried)
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                    outcome = "done" if error is None else "dead_letter" if tried >= most else "retry"
                    out.append((r.event_id, r.payload, tried, outcome, error, None))
                    if outcome != "retry":
                        break
            yield pd.DataFrame(out, columns=["event_id", "payload", "attempts", "outcome", "error", "due_ms"])

    return waiting_events(spark, checkpoint).mapInPandas(work, schema)


class _Slots(StatefulProcessor):
    """The last slot of a queue; the rows of a batch take theirs in order of time."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "slot long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["us", "tie"], kind="stable", na_position="first")
        last = self.last.get()[0] if self.last.exists() else None
        slots = []
        for us in part["us"].tolist():
            last = us if last is None else max(us, last + self.gap)
            slots.append(int(last))
        self.last.update((int(last),))
        yield part[["us", "tie"]].assign(key=key[0], slot_us=slots)[["key", "tie", "us", "slot_us"]]

    def close(self) -> None:
        pass


def slot_stream(events: DataFrame, per_minute: float, ts: str = "ts", tie: str = "event_id", key: str | Column | None = None) -> DataFrame:
    """``key, tie, us, slot_us`` of a stream of events: ``ingest.token_slots`` with the last slot of each queue as state.

    Rows of a batch go in order of time, batches as they come. Where they come in order of time, the slots are those of
    ``token_slots``. A queue is sequential by nature; without ``key`` there is one. Rows without a time are left out.
    """
    use_rocksdb(events.sparkSession)
    queue = F.lit("") if key is None else (F.col(key) if isinstance(key, str) else key).cast("string")
    rows = events.select(queue.alias("key"), F.col(tie).cast("long").alias("tie"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).where(F.col("us").isNotNull())
    out = StructType.fromDDL("key string, tie long, us long, slot_us long")
    return rows.groupBy("key").transformWithStateInPandas(_Slots(round(60_000_000 / per_minute)), out, "append", "None")
