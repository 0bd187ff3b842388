"""Per-user rate limit on a stream."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from assayer import fixed_values as fv
from assayer.functions.times import micros

OUTPUT = "event_id string, user_id string, at timestamp, accepted boolean"
ROWS_AT_ONCE = 10_000


def judge(times: np.ndarray, last: int | None, wait: int) -> np.ndarray:
    """Whether each of the ordered times is accepted, ``last`` being the last
    accepted one before; only accepted times are visited."""
    accepted = np.zeros(len(times), bool)
    at = 0 if last is None else int(np.searchsorted(times, last + wait, side="right"))
    while at < len(times):
        accepted[at] = True
        at = int(np.searchsorted(times, times[at] + wait, side="right"))
    return accepted


class Limiter(StatefulProcessor):
    """State: the user's last accepted time, gone once it cannot matter any more."""

    def __init__(self, wait: int) -> None:
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint")

    def _expiry(self, last: int) -> int:
        """Milliseconds after which any event is accepted."""
        return max((last + self.wait) // 1000 + 1, 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        times, ids = [], []
        for batch in rows:
            times.append(batch["t"].to_numpy(np.int64))
            ids.append(batch["event_id"].to_numpy(object))
        t, names = np.concatenate(times), np.concatenate(ids)
        order = np.lexsort((names.astype(str), t))
        t, names = t[order], names[order]
        before = self.last.get()[0] if self.last.exists() else None
        accepted = judge(t, before, self.wait)
        if accepted.any():
            last = int(t[accepted][-1])
            self.last.update((last,))
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            self.handle.registerTimer(self._expiry(last))
        for low in range(0, len(t), ROWS_AT_ONCE):
            part = slice(low, low + ROWS_AT_ONCE)
            yield pd.DataFrame({"event_id": names[part], "user_id": key[0], "at": pd.to_datetime(t[part], unit="us"), "accepted": accepted[part]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, wait_seconds: int = fv.REVIEW_WAIT_SECONDS, late: str = "1 day") -> DataFrame:
    """Verdict per event (event_id, user_id, at): accepted when more than the wait
    lies between it and the user's last accepted event.

    Events of a micro-batch are ordered by time within a user; equal times by id.
    The state is one number per user and goes when the watermark, ``late`` behind
    the newest event, has passed the wait: what comes then is accepted anyway.
    Events behind the watermark get no verdict. Timers need the state store that
    ``session.configure`` sets.
    """
    # a watermark starts at 1970 and takes what is not later for late
    clock = F.greatest("at", F.timestamp_millis(F.lit(1))).alias("clock")
    keyed = events.select(F.col("event_id").cast("string"), F.col("user_id").cast("string"), clock, micros(F.col("at")).alias("t"))
    return keyed.withWatermark("clock", late).groupBy("user_id").transformWithStateInPandas(Limiter(wait_seconds * 1_000_000), OUTPUT, "Append", "EventTime")
