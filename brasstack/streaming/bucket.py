"""A leaky bucket per provider as streaming state: calls queue, timers release them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RELEASED = "provider string, call_id long, asked_ms long, release_ms long"


_NONE = pd.DataFrame({"provider": pd.Series(dtype=str), "call_id": pd.Series(dtype="int64"), "asked_ms": pd.Series(dtype="int64"), "release_ms": pd.Series(dtype="int64")})
#: Times between calls that one entry of the waiting calls spans.
SPAN = 1_000


class Bucket(StatefulProcessor):
    """Releases the calls of a provider in the order they came in: `rate` of them at once, then one each period / rate.

    State: the time at which the bucket is empty, and the calls that wait, in a map by spans of release time, so a span
    holds at most SPAN + rate calls. One timer stands at the earliest release; it lets go of all calls that event time has
    reached and moves on to the next. All times are whole milliseconds; the time between calls is rounded up.
    """

    def __init__(self, rate: int, period_ms: int):
        if rate < 1 or period_ms < 1:
            raise ValueError("rate and period must be positive")
        self.gap = -(-period_ms // rate)
        self.slack = (rate - 1) * self.gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.empty_at = handle.getValueState("empty_at", "at long")
        self.waiting = handle.getMapState("waiting", "span long", "calls array<struct<call_id:bigint,asked:bigint,release:bigint>>")

    def _held(self, span: int) -> list[tuple]:
        return [tuple(c) for c in self.waiting.getValue((span,))[0]] if self.waiting.containsKey((span,)) else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a batch's rows of one provider: bounded by the trigger's files or bytes
        calls = pd.concat([r[["asked_ms", "call_id"]] for r in rows]).sort_values(["asked_ms", "call_id"])
        empty = self.empty_at.get()[0] if self.empty_at.exists() else None
        spans: dict[int, list] = {}
        first = None
        for asked, call in zip(calls["asked_ms"].tolist(), calls["call_id"].tolist(), strict=True):
            release = asked if empty is None else max(asked, empty - self.slack)
            empty = (asked if empty is None else max(asked, empty)) + self.gap
            spans.setdefault(release // (SPAN * self.gap), []).append((call, asked, release))
            first = release if first is None else min(first, release)
        for span, some in spans.items():
            self.waiting.updateValue((span,), (self._held(span) + some,))
        if first is not None:
            self.empty_at.update((empty,))
            self.handle.registerTimer(first)
        yield _NONE

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for span in sorted(k[0] for k in self.waiting.keys()):
            calls = self._held(span)
            ready = [(key[0], *c) for c in calls if c[2] <= now]
            left = [c for c in calls if c[2] > now]
            if ready and left:
                self.waiting.updateValue((span,), (left,))
            elif ready:
                self.waiting.removeKey((span,))
            if ready:
                yield pd.DataFrame(ready, columns=["provider", "call_id", "asked_ms", "release_ms"])
            if left:
                self.handle.registerTimer(min(c[2] for c in left))
                break
        else:
            yield _NONE

    def close(self) -> None:
        pass


def released(calls: DataFrame, rate: int, period_ms: int, late: str = "0 seconds") -> DataFrame:
    """(provider, call_id, asked_ms, release_ms) of a stream of calls (provider, call_id, ts), once event time reaches their release.

    A call that comes later than `late` behind the newest one is left out by the watermark; of one batch calls queue by time and id.
    Calls without provider, id or time are left out. A provider is one key: its bucket orders all its calls.
    """
    own = calls.filter("provider IS NOT NULL AND call_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    asked = own.select("provider", F.col("call_id").cast("long").alias("call_id"), "ts", F.unix_millis("ts").alias("asked_ms"))
    return asked.groupBy("provider").transformWithStateInPandas(Bucket(rate, period_ms), RELEASED, "Append", "EventTime")
