"""Streams that keep state by key: admission against caps, and claims that nobody finishes.

State is what is open, no more: an event-time timer frees a window when it closes, and a claim's state goes with its end. A key's
rows of a batch are taken in order of time, whatever their order in the files. Both need the RocksDB state store
(:func:`use_state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attesta.operators.limits import Caps, kind_cap

_EVENT = "event_id long, ts timestamp, network long, workspace_id string, kind string, refused_by string, hour_ends timestamp, day_ends timestamp"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(moments: pd.Series) -> pd.Series:
    return moments.astype("datetime64[ms]").astype("int64")


class WindowCap(StatefulProcessor):
    """Refuses the events of a key's window that come after the first ``cap`` ones, and passes on what others refused before.

    The state of a key is the list of its open windows (end in ms, events that reached this cap). ``ends`` names the column
    with the window's end, ``cap`` is a number or has one for each kind. A key has one timer, for the first of its windows that
    ends: it frees all that are over and moves on to the next, as a timer for each would cost a call for each.
    """

    def __init__(self, scope: str, ends: str, cap: int, kinds: dict[str, int] | None = None) -> None:
        self.scope, self.ends, self.cap, self.kinds = scope, ends, cap, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ends array<long>, used array<long>")

    def _load(self) -> dict[int, int]:
        held = self.open.get()
        return dict(zip(held[0], held[1], strict=True)) if held else {}

    def _store(self, windows: dict[int, int]) -> None:
        if windows:
            self.open.update((list(windows), list(windows.values())))
        else:
            self.open.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], ignore_index=True)
        windows = self._load()
        before = min(windows, default=None)
        ends = _ms(batch[self.ends])
        alive = batch["refused_by"].isna()
        place = alive.astype("int64").groupby(ends).cumsum() + ends.map(windows).fillna(0).astype("int64")
        cap = self.cap if self.kinds is None else batch["kind"].map(self.kinds).fillna(self.cap)
        batch.loc[alive & (place > cap), "refused_by"] = self.scope
        for end, n in alive.groupby(ends).sum().items():
            windows[int(end)] = windows.get(end, 0) + int(n)
        if before != min(windows):
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(min(windows))
        self._store(windows)
        yield batch

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        windows = {end: n for end, n in self._load().items() if end > over}
        self._store(windows)
        if windows:
            self.handle.registerTimer(min(windows))
        yield from ()

    def close(self) -> None:
        pass


def stream_admitted(events: DataFrame, caps: Caps = Caps(), late: str = "10 minutes") -> DataFrame:
    """A stream of events (event_id, ts, network, workspace_id, kind) with ``refused_by``, the first cap that each failed.

    The caps follow each other as stateful steps: network and hour, workspace, kind and hour, everybody's hour, everybody's
    day. An event's place is after those of earlier batches, and by time within its batch. An hour stays open until the newest
    hour seen lies ``late`` behind it; an event for a closed hour is dropped, and the query's progress counts it
    (numRowsDroppedByWatermark). A day's state goes once its last hour has closed.
    """
    cast = {"network": "long", "workspace_id": "string", "event_id": "long", "kind": "string"}
    rows = events.select(*[F.col(c).cast(k) for c, k in cast.items()], "ts").withColumns({
        "refused_by": F.lit(None).cast("string"),
        "hour_ends": F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR"),
        "day_ends": F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY"),
    }).withWatermark("hour_ends", late)
    steps = (
        (["network"], WindowCap("network", "hour_ends", caps.network)),
        (["workspace_id", "kind"], WindowCap("workspace", "hour_ends", caps.hour, dict(caps.kinds))),
        (["hour_ends"], WindowCap("hour", "hour_ends", caps.hour)),
        (["day_ends"], WindowCap("day", "day_ends", caps.day)),
    )
    columns = [x.split()[0] for x in _EVENT.split(", ")]
    for keys, step in steps:
        by = [(F.unix_millis(k) if k.endswith("_ends") else F.col(k)).alias(f"by_{k}") for k in keys]
        rows = rows.select(*columns, *by).groupBy(*[f"by_{k}" for k in keys]).transformWithStateInPandas(step, _EVENT, "Append", "EventTime", eventTimeColumnName="hour_ends")
    return rows.select("event_id", "ts", "network", "workspace_id", "kind", "refused_by")


class Claims(StatefulProcessor):
    """Follows an item's claims: one that is not finished in time is handed out again, and fails after so many attempts.

    The state of an item is its attempts and when its claim is due (ms); finished and failed items have none. What is due is
    settled by the item's next event or by a timer, whichever comes first, so the outcome does not depend on the batches.
    """

    def __init__(self, patience_ms: int, attempts: int, by_events: bool) -> None:
        self.patience, self.most, self.by_events = patience_ms, attempts, by_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", "attempts int, due long")

    def _settle(self, held: tuple[int, int] | None, until: int, told: list) -> tuple[int, int] | None:
        while held and held[1] <= until:
            attempts, due = held
            failed = attempts >= self.most
            told.append((due, "failed" if failed else "pending", attempts))
            held = None if failed else (attempts + 1, due + self.patience)
        return held

    def _keep(self, before: tuple | None, held: tuple[int, int] | None) -> None:
        if before and (not held or held[1] != before[1]):
            self.handle.deleteTimer(int(before[1]))
        if held:
            self.claim.update(held)
            if not before or held[1] != before[1]:
                self.handle.registerTimer(held[1])
        elif before:
            self.claim.clear()

    def _told(self, key: tuple, told: list) -> Iterator[pd.DataFrame]:
        if told:
            at = pd.to_datetime([t[0] for t in told], unit="ms").astype("datetime64[us]")
            yield pd.DataFrame({"item_id": [key[0]] * len(told), "at": at, "state": [t[1] for t in told], "attempts": np.array([t[2] for t in told], "int32")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        before = held = tuple(self.claim.get() or ()) or None
        told: list = []
        for at, event in zip(_ms(batch["ts"]), batch["event"], strict=True):
            held = self._settle(held, int(at), told)
            held = ((held[0] if held else 0) + 1, int(at) + self.patience) if event == "claimed" else None
        self._keep(before, held)
        yield from self._told(key, told)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = tuple(self.claim.get() or ()) or None
        now = timerValues.getCurrentWatermarkInMs() if self.by_events else timerValues.getCurrentProcessingTimeInMs()
        told: list = []
        held = self._settle(before, now, told)
        if held:
            self.claim.update(held)
            self.handle.registerTimer(held[1])
        elif before:
            self.claim.clear()
        yield from self._told(key, told)

    def close(self) -> None:
        pass


def stream_claims(events: DataFrame, minutes: float = 5, attempts: int = 3, late: str | None = "0 minutes") -> DataFrame:
    """(item_id, at, state, attempts): what becomes of claims that no later event finishes.

    ``events``: item_id, ts, event_id, event (``claimed`` or ``done``). A claim that is as old as ``minutes`` is pending and
    handed out again, which counts as an attempt; the last attempt fails. Time is that of the events, behind which the
    watermark lies ``late``, or, with ``late`` None, the clock's: then rows are told without any input.
    """
    kinds = "item_id long, at timestamp, state string, attempts int"
    rows = events.select(F.col("item_id").cast("long"), "ts", "event_id", "event")
    rows = rows.withWatermark("ts", late) if late is not None else rows
    step = Claims(int(minutes * 60_000), attempts, late is not None)
    return rows.groupBy("item_id").transformWithStateInPandas(step, kinds, "Append", "EventTime" if late is not None else "ProcessingTime")
