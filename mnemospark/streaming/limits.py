"""Budgets of calls over a stream, by event time: the rows of operators.limits.admitted_load.

A scope's calls wait in keyed state until the watermark has passed them, and are then decided in the order of time and key, so
files that overlap or come in any order give the same answers. What a scope keeps is the calls that wait (as many as the
delay allows) and the admitted ones of one window; a timer at the first waiting call's time wakes it. A call later than the
watermark is refused without being counted: its row says so (admitted false, retry_after null). Calls with the same key
are calls of their own. A call without time or without key has no place in the order and gets no row.

One budget for all is one scope, and one task of each batch: that is the order that the answers depend on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import thresholds as th
from ..operators.limits import Budget
from .ledger import _PROVIDER

ANSWER = "key long, scope long, admitted boolean, retry_after long"


class _Limiter(StatefulProcessor):
    def __init__(self, budget: dict):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, key long, chars long")
        self.entries = handle.getListState("entries", "at double, chars long")
        self.upto = handle.getValueState("upto", "at long")

    def _answers(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        frame = pd.DataFrame(rows, columns=["key", "scope", "admitted", "retry_after"])
        frame["retry_after"] = frame["retry_after"].astype("Int64")
        yield frame

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = self.upto.get()[0] if self.upto.exists() else None
        late, added = [], []
        for frame in rows:
            for at, k, chars in zip(frame["at"], frame["key"], frame["chars"], strict=True):
                if passed is not None and at <= passed:
                    late.append((int(k), key[0], False, None))
                else:
                    added.append((int(at), int(k), 0 if pd.isna(chars) else int(chars)))
        if added:
            self.waiting.appendList(added)
            self.handle.registerTimer(min(at for at, _, _ in added) // 1000 + 1)
        yield from self._answers(late)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        calls = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [c for c in calls if c[0] <= upto], [c for c in calls if c[0] > upto]
        limit = Budget(**self.budget, entries=[tuple(x) for x in self.entries.get()] if self.entries.exists() else [])
        out = [(k, key[0], *limit.check(at / 1e6, chars)) for at, k, chars in due]
        for state, left in ((self.waiting, rest), (self.entries, limit.entries)):
            state.put(left) if left else state.clear()
        self.upto.update((upto,))
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        yield from self._answers(out)

    def close(self) -> None:
        pass


def admitted_load(stream: DataFrame, scope: str = "user_id", key: str = "event_id", ts: str = "ts", chars: str = "chars", delay: str = "1 hour", calls: int = th.CALLS_PER_WINDOW, most_chars: int = th.CHARS_PER_WINDOW, seconds: float = th.WINDOW_SECONDS) -> DataFrame:
    """key, scope, admitted, retry_after of a stream of calls; those up to `delay` behind the latest one are in time."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    at = F.col(ts).cast("timestamp")
    known = stream.select(at.alias("ts"), F.unix_micros(at).alias("at"), F.col(scope).cast("long").alias("scope"), F.col(key).cast("long").alias("key"), F.col(chars).cast("long").alias("chars"))
    # Spark drops rows behind the watermark before the operator; those between it and the last decided call are answered as late.
    known = known.where("at is not null and key is not null").withWatermark("ts", delay)
    return known.groupBy("scope").transformWithStateInPandas(_Limiter({"calls": calls, "chars": most_chars, "seconds": seconds}), ANSWER, "append", "EventTime")
