"""Leases over a stream of claims and heartbeats: fenced tokens, deadlines, and expiry by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Attempts of an item after which an expired lease is its end.
ATTEMPTS = 3
#: What an item remembers: idle, running, completed or failed; the holder, its token, and when its lease ends.
STATE = "item long, status string, owner string, token long, until long, attempts long"
OUTPUT = "item long, event long, millis long, outcome string, owner string, token long, until long"
#: Ids, as bits, whose items are one key of the state: reading, writing and timing a key costs some 15 ms, whatever it
#: holds.
RANGE = 12


class Leases(StatefulProcessor):
    """Rows of (item, event, millis, kind, owner, token, lasts, deadline), times in milliseconds, to one row a decision.

    claim: granted to the owner, with the next token, if the item is idle and its deadline ahead, until `lasts` has
    passed or the deadline comes; else refused. heartbeat: extended likewise if the owner holds the lease by that
    token; else stale. complete: completed, likewise. A lease that runs out is expired, and its item idle again, or
    failed after ATTEMPTS: at the next event of the item, or by a timer once the watermark has passed its end.

    Items are decided on by themselves; a range of 2^RANGE ids shares one list of states and one timer, for the first
    end of its leases."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("leases", STATE)

    def _read(self) -> dict[int, list]:
        return {int(item): list(state) for item, *state in self.held.get()} if self.held.exists() else {}

    def _first(self, held: dict[int, list]) -> int | None:
        return min((s[3] for s in held.values() if s[0] == "running"), default=None)

    def _expired(self, item: int, state: list) -> tuple:
        status, owner, token, until, attempts = state
        state[0] = "failed" if attempts >= ATTEMPTS else "idle"
        return (item, None, until, "failed" if attempts >= ATTEMPTS else "expired", owner, token, until)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._read(), []
        before = self._first(held)
        for r in pd.concat(list(rows)).sort_values(["item", "millis", "event"]).itertuples():
            item, at = int(r.item), int(r.millis)
            state = held.setdefault(item, ["idle", None, 0, 0, 0])
            if state[0] == "running" and state[3] <= at:
                out.append(self._expired(item, state))
            until = min(at + int(r.lasts), int(r.deadline))
            mine = state[0] == "running" and state[1] == r.owner and state[2] == int(r.token)
            if r.kind == "claim":
                granted = state[0] == "idle" and r.deadline > at
                if granted:
                    state[:] = ["running", r.owner, state[2] + 1, until, state[4] + 1]
                out.append((item, int(r.event), at, "granted" if granted else "refused", r.owner, state[2] if granted else None, until if granted else None))
            elif not mine:
                out.append((item, int(r.event), at, "stale", r.owner, int(r.token), None))
            elif r.kind == "heartbeat":
                state[3] = until
                out.append((item, int(r.event), at, "extended", r.owner, state[2], until))
            else:
                state[0] = "completed"
                out.append((item, int(r.event), at, "completed", r.owner, state[2], None))
        after = self._first(held)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        self.held.put([(item, *state) for item, state in held.items()])
        yield from self._frames(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._read()
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        out = [self._expired(item, state) for item, state in held.items() if state[0] == "running" and state[3] <= passed]
        if out:
            self.held.put([(item, *state) for item, state in held.items()])
            if (after := self._first(held)) is not None:
                self.handle.registerTimer(after)
        yield from self._frames(out)

    def _frames(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names if c not in ("outcome", "owner")})

    def close(self) -> None:
        pass


def leased(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Decisions on a stream of (item, event, millis, kind, owner, token, lasts, deadline) with an event time whose
    watermark is `late` behind. Needs the RocksDB state store."""
    rows = stream.withWatermark(time, late).withColumn("ids", F.shiftright("item", RANGE))
    return rows.groupBy("ids").transformWithStateInPandas(Leases(), OUTPUT, "append", "eventTime")


def with_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
