"""Stateful stream forms with timers: events are held until the watermark has
passed them, so they act in event order whatever files they came in, and a key
that has nothing left to do leaves the state store.

The four processors share one shape: what arrives is appended to a list state,
one event-time timer a key stands at the next instant at which something can
be settled, and a fired timer settles everything up to the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _us(ts: pd.Series) -> list[int]:
    return (ts.astype("datetime64[us]").astype("int64")).tolist()


def _at(us: int | None) -> pd.Timestamp:
    return pd.NaT if us is None else pd.Timestamp(us, unit="us")


class EventOrder(StatefulProcessor):
    """Rows of a key in event order: ``settle`` gets those that the watermark
    has passed, by (time, id), and the key's value state; the key expires
    ``keep_us`` after its last settled event."""

    #: fields of an event beside ``us bigint, id bigint``, and of the value state
    event_fields, value_fields, keep_us = "", "", 0

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, id bigint" + self.event_fields)
        self.value = handle.getValueState("value", "last bigint, " + self.value_fields)

    def events(self, pdf: pd.DataFrame) -> list[tuple]:
        raise NotImplementedError

    def settle(self, key: tuple, events: list[tuple], value: tuple | None) -> tuple[tuple | None, list[dict]]:
        raise NotImplementedError

    def finish(self, key: tuple, value: tuple) -> list[dict]:
        """Rows for a key that leaves the store."""
        return []

    def _stand(self, ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [e for pdf in rows for e in self.events(pdf)]
        self.waiting.appendList(new)
        first = min(e[0] for e in new)
        timers = list(self.handle.listTimers())
        due = -(-first // 1000)
        had = list(self.waiting.get()) if timers else new
        if not timers or due < timers[0] or len(had) == len(new):
            self._stand(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(e) for e in self.waiting.get()) if self.waiting.exists() else []
        ready = [e for e in held if e[0] <= passed]
        rest = held[len(ready):]
        stored = self.value.get() if self.value.exists() else None
        last, value = (stored[0], tuple(stored[1:])) if stored is not None else (None, None)
        out: list[dict] = []
        if ready:
            value, out = self.settle(key, ready, value)
            last = ready[-1][0]
            if value is None:
                self.value.clear()
            else:
                self.value.update((last, *value))
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if rest:
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        elif value is not None:
            ends = -(-(self.ends(last, value)) // 1000)
            if ends <= timerValues.getCurrentWatermarkInMs():
                out += self.finish(key, value)
                self.value.clear()
            else:
                self.handle.registerTimer(ends)
        if out:
            yield pd.DataFrame(out)

    def ends(self, last: int, value: tuple) -> int:
        return last + self.keep_us

    def close(self) -> None:
        pass


class History(EventOrder):
    """Each status with the one before it."""

    event_fields, value_fields = ", status string", "status string"

    def __init__(self, keep_us: int):
        self.keep_us = keep_us

    def events(self, pdf):
        return list(zip(_us(pdf["ts"]), pdf["event_id"].tolist(), pdf["status"].tolist(), strict=True))

    def settle(self, key, events, value):
        prev, out = (value[0] if value else None), []
        for _, event_id, status in events:
            out.append({"doc_id": key[0], "event_id": event_id, "prev_status": prev, "status": status})
            prev = status
        return (prev,), out


class Anchors(EventOrder):
    """The first sighting of a content, then the next one a delay or more
    after the last that was kept."""

    event_fields, value_fields = "", "anchor bigint"

    def __init__(self, delay_us: int):
        self.keep_us = self.delay_us = delay_us

    def events(self, pdf):
        return list(zip(_us(pdf["ts"]), pdf["event_id"].tolist(), strict=True))

    def settle(self, key, events, value):
        anchor, out = (value[0] if value else None), []
        for us, event_id in events:
            if anchor is None or us >= anchor + self.delay_us:
                anchor = us
                out.append({"content_hash": key[0], "event_id": event_id, "ts": _at(us)})
        return (anchor,), out

    def ends(self, last, value):
        return value[0] + self.delay_us


class MonthCounts(EventOrder):
    """The number of events of a (user, month) once the watermark has
    passed the month's end, one row a key; only a count is held."""

    event_fields, value_fields = "", "n bigint, ends bigint"

    def events(self, pdf):
        ends = (pd.DatetimeIndex(pdf["period"]) + pd.DateOffset(months=1)).astype("datetime64[us]").astype("int64")
        return [(int(e) - 1, int(n)) for e, n in zip(ends, pdf["n"].tolist(), strict=True)]

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        new = [e for pdf in rows for e in self.events(pdf)]
        stored = self.value.get() if self.value.exists() else (None, 0, 0)
        n, end = stored[1] + sum(e[1] for e in new), new[0][0] + 1
        self.value.update((end, n, end))
        self._stand(max(-(-end // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def finish(self, key, value):
        return [{"user_id": key[0], "period": pd.Timestamp(key[1]).tz_localize(None), "docs_used": value[0]}]


class LastWriters(EventOrder):
    """Per field the value of the last event that wrote it, with that
    event's (time, id); a customer that has been quiet leaves the store with
    one row, to be merged into the stored fold by ``merge_folds``."""

    def __init__(self, fields: dict[str, str], keep_us: int):
        self.fields, self.keep_us = fields, keep_us
        self.event_fields = "".join(f", {c} {t}" for c, t in fields.items())
        self.value_fields = ", ".join(f"{c} {t}, {c}_us bigint, {c}_id bigint" for c, t in fields.items())

    def events(self, pdf):
        plain = {"int": int, "bigint": int, "boolean": bool, "string": str}  # pandas holds numbers beside nulls as floats
        cols = [[None if pd.isna(v) else plain[t](v) for v in pdf[c].tolist()] for c, t in self.fields.items()]
        return list(zip(_us(pdf["ts"]), pdf["event_id"].tolist(), *cols, strict=True))

    def settle(self, key, events, value):
        held = list(value) if value else [None] * 3 * len(self.fields)
        for us, event_id, *written in events:
            for i, v in enumerate(written):
                if v is not None:
                    held[3 * i:3 * i + 3] = [v, us, event_id]
        return tuple(held), []

    def finish(self, key, value):
        row = {"customer_ref": key[0]}
        for i, (c, t) in enumerate(self.fields.items()):
            row |= {c: value[3 * i], f"{c}_us": value[3 * i + 1], f"{c}_id": value[3 * i + 2]}
        return [row]


def run_stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """Append-mode stream of what ``processor`` emits; keyed state lives in
    RocksDB (on disk), since it may outgrow an executor's memory."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventtime")


def duration_us(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1_000_000)


def merge_folds(rows: DataFrame, fields: list[str], key: str = "customer_ref") -> DataFrame:
    """Stored and newly emitted folds as one: per field the value with the
    latest (time, id)."""
    last = lambda c: F.max_by(F.struct(c, f"{c}_us", f"{c}_id"), F.when(F.col(f"{c}_us").isNotNull(), F.struct(f"{c}_us", f"{c}_id")))
    merged = rows.groupBy(key).agg(*[last(c).alias(c) for c in fields])
    return merged.select(key, *[x for c in fields for x in (F.col(f"{c}.{c}").alias(c), F.col(f"{c}.{c}_us"), F.col(f"{c}.{c}_id"))])
