"""Online suppression: of a stream of updates only those that the models don't predict."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kernels import object_type


def online_compress(updates: DataFrame, model: dict[tuple[int, ...], int], order: int, delay: str | None = None, times: dict[int, tuple[float, float]] | None = None, most: float = 0.0, gps_sigma: float = 5.0) -> DataFrame:
    """updates(obj, id, seg, time[, ts]), batch or stream, to (obj, id, seg, time) of first and unpredicted rows.

    State: an object's last `order` segments, how many it has had, and with times {seg: (mean, deviation)}
    what the travel-time model says and what it has learned; then rows go as well whose time it misses by
    more than `most`. Rows of a micro-batch are taken in order of id; later ones that come with a smaller
    id than one before are taken as they come.

    delay: with an event-time column ts, rows later than that are dropped by the watermark, and an object
    that is silent for as long has its last row sent, so what is stored has an end, and its state goes.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, _, last, sent, *_ = state.get
            state.remove()
            rows = [] if sent else [(key[0], *last)]
            yield pd.DataFrame(rows, columns=["obj", "id", "seg", "time"]).astype({"id": int, "seg": int, "time": "Int64"})
            return
        seen, history, last, sent, told, fused, before = state.get if state.exists else (0, [], None, True, 0.0, 0.0, 0)
        history = list(history)
        rows = pd.concat(list(parts)).sort_values("id", kind="stable")
        out = []
        for i, seg, t in zip(rows["id"], rows["seg"], rows["time"], strict=True):
            seg, t = int(seg), None if pd.isna(t) else int(t)
            guess = next((model[c] for k in range(min(order, len(history)), 0, -1) if (c := tuple(history[-k:])) in model), 0)
            keep = not seen or guess != seg
            if times is not None and t is not None:
                mean, spread = times.get(seg, (0.0, 1.0))
                if not seen:
                    told = fused = float(t)
                else:
                    gain = spread**2 / (spread**2 + gps_sigma**2)
                    fused += mean + gain * (t - before - mean)
                    told += mean
                    if abs(told - fused) > most:
                        keep, told = True, fused
                before = t
            if keep:
                out.append((key[0], int(i), seg, t))
            seen, history, last, sent = seen + 1, [*history, seg][-order:], (int(i), seg, t), keep
        state.update((seen, history, last, sent, told, fused, before))
        if delay is not None:
            state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + wait)
        yield pd.DataFrame(out, columns=["obj", "id", "seg", "time"]).astype({"id": int, "seg": int, "time": "Int64"})

    wait = 1
    if delay is not None:
        updates = updates.withWatermark("ts", delay)
        wait = int(pd.Timedelta(delay).total_seconds() * 1000)
    kind = f"obj {object_type(updates)}, id int, seg int, time long"
    held = "seen long, history array<int>, last struct<id: int, seg: int, time: long>, sent boolean, told double, fused double, before long"
    timeout = GroupStateTimeout.EventTimeTimeout if delay is not None else GroupStateTimeout.NoTimeout
    return updates.groupBy("obj").applyInPandasWithState(run, kind, held, "append", timeout)


def latest(updates: DataFrame, delay: str, window: str) -> DataFrame:
    """(start, obj, seg, time): where each object of a stream was last in each window of event time ts, once the watermark is past it."""
    own = updates.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "obj")
    return own.agg(F.max_by("seg", F.struct("time", "id")).alias("seg"), F.max("time").alias("time")).select(F.col("w.start").alias("start"), "obj", "seg", "time")
