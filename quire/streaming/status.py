"""The status of books as keyed streaming state: events change it in the order of their times, and a start while a book is translating is refused.

Events of a book wait in state until the watermark has passed them, so those
that come late, within the delay, are still taken in order. A timer of the book
stands at its earliest waiting event. State lives in the checkpoint; a query
that is started again goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What each kind of event makes of a book; a start may be refused.
STATUS_AFTER = {"start": "translating", "complete": "completed", "cancel": "none", "fail": "none"}
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_WAITING = T.StructType([T.StructField("at", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("kind", T.StringType())])
_STATUS = T.StructType([T.StructField("status", T.StringType())])


class StatusMachine(StatefulProcessor):
    """Per book: the status, and events that the watermark has not passed yet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", _STATUS)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = [(r.at, r.event_id, r.kind) for r in rows]
        if came:
            first = min(at for at, *_ in came)
            before = [t for t in self.handle.listTimers()]
            self.waiting.appendList(came)
            if not before or first < min(before):
                for t in before:
                    self.handle.deleteTimer(t)
                # a timer fires once the watermark has passed it
                self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        every = sorted((r[0], r[1], r[2]) for r in self.waiting.get())
        due = [e for e in every if e[0] <= now]
        later = every[len(due) :]
        status = self.status.get()[0] if self.status.exists() else "none"
        out = []
        for at, event_id, kind in due:
            refused = kind == "start" and status == "translating"
            status = STATUS_AFTER[kind]
            out.append(Row(book_id=key[0], event_id=event_id, at=at, kind=kind, refused=refused, translation_status=status))
        if due:
            self.status.update((status,))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0])
        return iter(out)

    def close(self) -> None:
        pass


def status_changes(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of events (event_id, book_id, ts, kind) to (book_id, event_id, at in ms, kind, refused, translation_status).

    Events of other kinds, without a book or a time are left out. Equal times go
    by event_id. Events later than ``delay`` behind the newest time are lost, as
    watermarks have it. The session's state store must be RocksDB (``STORE``).
    """
    key = events.schema["book_id"].dataType
    known = events.where(F.col("kind").isin(*STATUS_AFTER) & F.col("book_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay)
    rows = known.select("book_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("bigint").alias("event_id"), "kind")
    out = T.StructType([T.StructField("book_id", key), T.StructField("event_id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("refused", T.BooleanType()), T.StructField("translation_status", T.StringType())])
    return rows.groupBy("book_id").transformWithState(statefulProcessor=StatusMachine(), outputStructType=out, outputMode="Append", timeMode="EventTime")
