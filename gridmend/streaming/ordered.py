"""Event order in streams: rows wait in keyed state until the watermark has passed them, and late rows are kept apart.

The engine drops rows behind the watermark before a stateful operator sees them. Here the watermark still drives the timers,
but the time that the operator reads is a plain column, so late rows arrive, are marked, and can be written to a table.
All state goes: waiting rows when they are released, the rest by a timer some time after the last event of its key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WATERMARK = "1 hour"
KEEP_MS = 7 * 86_400_000
_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def with_late_rows(events: DataFrame, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """The events with a watermark that drives timers but drops no row: ``ts`` becomes a column the engine does not know as
    event time."""
    return events.withWatermark(ts, delay).withColumn(ts, F.timestamp_micros(F.unix_micros(ts)))


class InOrder(StatefulProcessor):
    """Hands the events of a key to ``advance`` in order of (time, id). Repeated ids are dropped while they are known.

    Input columns: the key, at_us (microseconds), event_name, event_row (JSON). A row that comes after a later one was released is late,
    and so is one from before the time for which state is kept: it goes to ``advance`` by itself, marked.
    """

    def __init__(self, keep_ms: int = KEEP_MS):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id string, row string")
        self.known = handle.getMapState("known", "id string", "at long")
        self.mark = handle.getValueState("mark", "at long, id string, alarm long, sweep long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Further state of the operator."""

    def advance(self, key: tuple, rows: list[tuple], late: bool) -> pd.DataFrame:
        """Output for rows (at, id, row), which are in order."""
        raise NotImplementedError

    def forget(self, before: int) -> bool:
        """Drop state older than a time (microseconds); True if nothing is left."""
        return True

    def close(self) -> None:
        pass

    def _mark(self) -> list:
        return list(self.mark.get()) if self.mark.exists() else [-1 << 62, "", -1, -1]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, fresh, late = self._mark(), [], []
        # what a key had before its state went is not known: an event of that time is late
        if not self.mark.exists():
            mark[0] = (timerValues.getCurrentWatermarkInMs() - self.keep_ms) * 1000
        for pdf in rows:
            for at, ev, row in zip(pdf["at_us"], pdf["event_name"], pdf["event_row"]):
                if self.known.containsKey((ev,)):
                    continue
                self.known.updateValue((ev,), (int(at),))
                (late if (at, ev) < (mark[0], mark[1]) else fresh).append((int(at), ev, row))
        if fresh:
            self.waiting.appendList(fresh)
            first = min(fresh)[0] // 1000
            if mark[2] < 0 or first < mark[2]:
                if mark[2] >= 0:
                    self.handle.deleteTimer(mark[2])
                self.handle.registerTimer(first)
                mark[2] = first
        if mark[3] < 0 and (fresh or late):
            mark[3] = max(at for at, *_ in fresh + late) // 1000 + self.keep_ms + 1
            self.handle.registerTimer(mark[3])
        self.mark.update(tuple(mark))
        if late:
            yield self.advance(key, sorted(late), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.mark.exists():
            return  # an earlier timer of this batch has put everything away
        now, mark = timerValues.getCurrentWatermarkInMs(), self._mark()
        if mark[2] >= 0 and mark[2] <= now:
            held = sorted(self.waiting.get())
            ready = [r for r in held if r[0] // 1000 <= now]
            rest = held[len(ready):]
            if ready:
                mark[:2] = ready[-1][:2]
                yield self.advance(key, [tuple(r) for r in ready], False)
            if rest:
                self.waiting.put([tuple(r) for r in rest])
                mark[2] = rest[0][0] // 1000
                self.handle.registerTimer(mark[2])
            else:
                self.waiting.clear()
                mark[2] = -1
        if mark[3] >= 0 and mark[3] <= now:
            horizon = (now - self.keep_ms) * 1000
            old, young = [], []
            for k, (at,) in self.known.iterator():
                (old if at < horizon else young).append((k, at))
            for k, _ in old:
                self.known.removeKey(k)
            empty = self.forget(horizon)
            if young or mark[2] >= 0 or not empty:
                mark[3] = now + self.keep_ms
                self.handle.registerTimer(mark[3])
            else:
                self.mark.clear()
                return
        self.mark.update(tuple(mark))


def keyed_rows(events: DataFrame, keys: list[str], ts: str, ev_id: str, delay: str) -> DataFrame:
    """(keys, at_us, event_name, event_row) as ``InOrder`` reads them. Ids that are numbers are padded, so that their order holds."""
    rest = [c for c in events.columns if c not in (*keys, ts, ev_id)]
    body = F.to_json(F.struct(*rest), _FORMATS) if rest else F.lit("{}")
    number = events.schema[ev_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    name = F.lpad(F.col(ev_id).cast("string"), 20, "0") if number else F.col(ev_id).cast("string")
    return with_late_rows(events, ts, delay).select(*keys, F.unix_micros(ts).alias("at_us"), name.alias("event_name"), body.alias("event_row"))


class _Released(InOrder):
    def __init__(self, names: list[str], keep_ms: int):
        super().__init__(keep_ms)
        self.names = names

    def advance(self, key: tuple, rows: list[tuple], late: bool) -> pd.DataFrame:
        columns = list(zip(*rows))
        out = {n: [k] * len(rows) for n, k in zip(self.names, key)}
        return pd.DataFrame(out | {"at_us": columns[0], "event_name": columns[1], "event_row": columns[2], "late": late})


def in_event_order(events: DataFrame, keys: list[str], ts: str = "ts", ev_id: str = "ev_id", delay: str = WATERMARK, keep_ms: int = KEEP_MS) -> DataFrame:
    """The events again, each once, with ``late`` added.

    A micro-batch of the result holds, per key, only events later than all that earlier ones held, save the late ones. A
    batch operator applied to it in order therefore continues what it made of the batches before.
    """
    rows = keyed_rows(events, keys, ts, ev_id, delay)
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    out = rows.groupBy(*keys).transformWithStateInPandas(_Released(keys, keep_ms), ", ".join(f"{k} {types[k]}" for k in keys) + ", at_us long, event_name string, event_row string, late boolean", "Append", "EventTime")
    rest = [c for c in events.columns if c not in (*keys, ts, ev_id)]
    body = F.from_json("event_row", ", ".join(f"`{c}` {types[c]}" for c in rest), _FORMATS) if rest else F.lit(None)
    opened = out.withColumn("event_row", body)
    time = F.timestamp_micros("at_us").cast(types[ts])
    fields = {ts: time, ev_id: F.col("event_name").cast(types[ev_id])} | {c: F.col(f"event_row.`{c}`") for c in rest} | {k: F.col(k) for k in keys}
    return opened.select(*[fields[c].alias(c) for c in events.columns], "late")


def run_batches(ordered: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint_dir: str, late: Callable[[DataFrame, int], None] | None = None):
    """Start a stream that hands on-time rows to ``apply`` and late ones to ``late``, micro-batch by micro-batch."""

    def both(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            apply(kept.where("not late").drop("late"), number)
            if late is not None:
                late(kept.where("late").drop("late"), number)
        finally:
            kept.unpersist()

    return ordered.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def late_table(root: str) -> Callable[[DataFrame, int], None]:
    """Writes late rows to ``root``, one folder per micro-batch; a replayed batch replaces its own folder."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{root}/batch={number:012d}")


def parsed(rows: list[tuple]) -> list[tuple]:
    """(at, id, fields) of rows whose bodies are read."""
    return [(at, ev, json.loads(row)) for at, ev, row in rows]
