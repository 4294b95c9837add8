"""Lookups that may fail, as keyed state: how often a key was asked for, and when it is given up.

A 404 is an answer: the thing does not exist, and it is not asked for again. Any other failure is tried again until the budget is
used up, and a key that is not answered in time is given up by a timer. So "not there" and "could not check" stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# ---- fixed values -------------------------------------------------------------------------------------------------------
OK, NOT_FOUND, ERROR = "OK", "NOT_FOUND", "ERROR"
ATTEMPTS, FIRST_WAIT_MS = 3, 1000
# -------------------------------------------------------------------------------------------------------------------------
STATE = "attempts int, code int, deadline long"
OUT = "key string, status string, attempts int, value string"


class Lookups(StatefulProcessor):
    """Rows (key, at, code, value) to one row a key: OK with its value, NOT_FOUND, HTTP_<code> or ERROR, and the attempts made.

    ``code`` is null where an attempt had no answer; a row with code 0 only says that the key is asked for. After the n-th
    failure a key waits FIRST_WAIT_MS * 2^(n-1) of event time for the next answer and is then given up. Nothing after that changes it."""

    def __init__(self, attempts: int = ATTEMPTS, wait_ms: int = FIRST_WAIT_MS) -> None:
        self.most, self.wait = attempts, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lookup", STATE)

    def _given_up(self, key: str, attempts: int, code: int | None) -> pd.DataFrame:
        return pd.DataFrame({"key": [key], "status": [f"HTTP_{code}" if code else ERROR], "attempts": [attempts], "value": [None]})

    def _wait_until(self, deadline: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(deadline)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts, code, deadline = self.state.get() if self.state.exists() else (0, 0, 0)
        told = pd.concat(list(rows)).sort_values("at", kind="stable")
        for at, c, value in zip(told["at"], told["code"], told["value"], strict=True):
            now = int(pd.Timestamp(at).timestamp() * 1000)
            if deadline < 0:
                break  # settled before
            if deadline and now > deadline:
                yield self._given_up(key[0], attempts, code)
                deadline = -1
                break
            if not pd.isna(c) and c == 0:
                deadline = deadline or now + self.wait
                continue
            attempts += 1
            if not pd.isna(c) and c in (200, 404):
                yield pd.DataFrame({"key": [key[0]], "status": [OK if c == 200 else NOT_FOUND], "attempts": [attempts], "value": [value if c == 200 else None]})
                deadline = -1
            else:
                code = 0 if pd.isna(c) else int(c)
                if attempts >= self.most:
                    yield self._given_up(key[0], attempts, code)
                    deadline = -1
                else:
                    deadline = now + self.wait * 2 ** (attempts - 1)
        if deadline < 0:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        elif deadline:
            self._wait_until(deadline)
        self.state.update((int(attempts), int(code), int(deadline)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, code, deadline = self.state.get()
        if deadline >= 0:
            self.state.update((attempts, code, -1))
            yield self._given_up(key[0], attempts, code)

    def close(self) -> None:
        pass


def settled(answers: DataFrame, key: str = "key", late: str = "0 seconds", attempts: int = ATTEMPTS, wait_ms: int = FIRST_WAIT_MS) -> DataFrame:
    """A stream of answers (key, at, code, value) as a stream with one row for each key that is settled.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    rows = answers.withWatermark("at", late).selectExpr(f"cast(`{key}` as string) as key", "at", "code", "value")
    return rows.groupBy("key").transformWithStateInPandas(Lookups(attempts, wait_ms), OUT, "Append", "EventTime")
