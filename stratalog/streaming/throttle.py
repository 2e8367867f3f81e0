"""Greedy throttling: an event passes if enough time went by since the last one that passed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEAST_HZ, MOST_HZ = 1.0, 120.0


def interval_us(hz: float) -> int:
    return round(1e6 / min(MOST_HZ, max(LEAST_HZ, hz)))


def passing(times: np.ndarray, interval: int, last: int | None = None) -> np.ndarray:
    """Which of the rising times pass.  The search jumps from one to the next, so it takes a step an emitted event."""
    keep = np.zeros(len(times), dtype=bool)
    at = 0 if last is None else int(np.searchsorted(times, last + interval))
    while at < len(times):
        keep[at] = True
        at = int(np.searchsorted(times, times[at] + interval))
    return keep


def throttle(events: DataFrame, by: str, ts: str, hz: float | None = None, interval: int | None = None) -> DataFrame:
    """events that pass, for each key; ties in time in the order of all columns; events without a time do not pass.

    A task's events come sorted by key and time, batch by batch, and all it remembers is the last key and when that passed: a key of
    any size needs no more memory than a batch.  interval is in microseconds, for rates below the one that hz is held to.
    """
    step = interval or interval_us(hz)
    rest = [c for c in events.columns if c not in (by, ts)]
    us, key, columns = "__us", "__key", events.columns
    stamped = events.withColumns({us: F.unix_micros(F.col(ts).cast("timestamp")), key: F.xxhash64(by)}).where(F.col(us).isNotNull())
    ordered = stamped.repartition(key).sortWithinPartitions(key, by, us, *rest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before: tuple[object, int | None] | None = None
        for batch in batches:
            times, keys = batch[us].to_numpy(), batch[by]
            missing = keys.isna().to_numpy()
            new = np.ones(len(batch), dtype=bool)
            new[1:] = (keys.to_numpy()[1:] != keys.to_numpy()[:-1]) & ~(missing[1:] & missing[:-1])
            keep, starts = np.zeros(len(batch), dtype=bool), np.flatnonzero(new)
            for start, end in zip(starts, np.append(starts[1:], len(batch)), strict=True):
                mine = None if missing[start] else keys.iloc[start]
                last = before[1] if before is not None and before[0] == mine else None
                keep[start:end] = passing(times[start:end], step, last)
                passed = times[start:end][keep[start:end]]
                before = (mine, int(passed[-1]) if len(passed) else last)
            yield batch[keep][columns]

    return ordered.mapInPandas(run, events.schema)


def throttle_stream(events: DataFrame, by: str, ts: str, hz: float) -> DataFrame:
    """The same over a stream, by arrival: the state of a key is when it last passed; late events do not pass."""
    step = interval_us(hz)
    kind = dict(events.dtypes)[by]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = np.sort(np.concatenate([b["us"].to_numpy() for b in batches]))
        out = times[passing(times, step, last)]
        if len(out):
            state.update((int(out[-1]),))
        yield pd.DataFrame({by: [key[0]] * len(out), "us": out})

    stamped = events.select(by, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return stamped.groupBy(by).applyInPandasWithState(run, f"`{by}` {kind}, us long", "last long", "append", GroupStateTimeout.NoTimeout)
